"""python -m gridloom.cli --catalog C --schema S --landing-path P [--stage all]"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence
from datetime import date

from gridloom.context import RunContext
from gridloom.plans import pipeline
from gridloom.session import get_session
from gridloom.sources.synth import Options


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridloom")
    p.add_argument("--catalog", required=True)
    p.add_argument("--schema", required=True)
    p.add_argument("--landing-path", default="/tmp/gridloom-landing")
    p.add_argument("--stage", default="all", choices=["all", *pipeline.STAGES])
    p.add_argument("--n-sites", type=int, default=12)
    p.add_argument("--n-days", type=int, default=60)
    p.add_argument("--start-date", type=date.fromisoformat, default=date(2025, 1, 1))
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--log-level", default="INFO")
    return p


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=a.log_level)
    ctx = RunContext(a.schema, a.landing_path, a.catalog)
    stages = pipeline.STAGES if a.stage == "all" else (a.stage,)
    pipeline.run_stages(get_session(), ctx, stages, Options(a.n_sites, a.n_days, a.start_date, a.seed))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
