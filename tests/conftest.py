import os
import sys
from datetime import datetime
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from gridloom.session import get_session

    warehouse = tmp_path_factory.mktemp("warehouse")
    s = get_session("local[4]", 4, **{"spark.sql.warehouse.dir": str(warehouse), "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def ctx(spark, tmp_path):
    from gridloom.context import RunContext
    from gridloom.sources.storage import ensure_schema

    c = RunContext(f"t{os.urandom(4).hex()}", str(tmp_path / "landing"))
    ensure_schema(spark, c)
    yield c
    spark.sql(f"DROP SCHEMA IF EXISTS {c.database} CASCADE")


def raw(spark, feed, rows):
    """A raw frame from rows of text; a row may end with its ingest time."""
    from gridloom.sources.feeds import FEEDS

    columns = FEEDS[feed]
    default = datetime(2025, 2, 1)
    full = [(*r[: len(columns)], "file_1.csv", r[len(columns)] if len(r) > len(columns) else default, "b1") for r in rows]
    return spark.createDataFrame(full, ", ".join(f"{c} string" for c in columns) + ", _source_file string, _ingested_at timestamp, _batch_id string")


def ts(text):
    return datetime.fromisoformat(text)


def by(rows, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows}
