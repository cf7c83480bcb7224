"""Runs and gaps of a stream: which steps of an entity follow each other, and which are missing between them.

A run is final once the watermark has passed the step after it, as no row can lengthen it any more; then it goes out, and with it the gap between
it and the run before. Until then each entity's open runs are its state: pairs of steps, apart from each other, so rows may come in any order and any
number of times within the delay. Later rows are dropped, as the watermark has it, which starts at 1970. What comes out is what ``series.islands`` makes of
the rows that were in time, as far as the watermark has come. The state lies in the checkpoint and survives lost executors and restarts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RUN, GAP = "run", "gap"


def merged(runs: list[tuple[int, int]], steps: list[int]) -> list[tuple[int, int]]:
    """runs with more steps in them: sorted, and no two of them next to each other."""
    out: list[tuple[int, int]] = []
    for first, last in sorted([*runs, *((s, s) for s in steps)]):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def instant(stream: DataFrame, time: str) -> Column:
    """time as a timestamp; one without a zone is read as UTC, whatever the session's zone is."""
    c = F.col(time)
    if dict(stream.dtypes)[time] != "timestamp_ntz":
        return c.cast("timestamp")
    minutes = F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long") * 1440 + F.hour(c) * 60 + F.minute(c)
    return F.timestamp_micros(minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long"))


def runs_and_gaps(stream: DataFrame, entity: str, time: str, delay: str, step_seconds: int = 3600) -> DataFrame:
    """entity, kind, first_step, last_step, steps of each run and gap; a step is so many seconds, counted from 1970. Rows without entity or time don't count."""
    step_ms = step_seconds * 1000
    kind = dict(stream.dtypes)[entity]

    def settle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        firsts, lasts, before = state.get if state.exists else ([], [], None)
        runs = list(zip(firsts, lasts))
        if not state.hasTimedOut:
            for frame in frames:
                runs = merged(runs, frame["_step"].unique().tolist())
        ends = lambda last: (last + 2) * step_ms  # noqa: E731  when the step after it is over
        watermark = state.getCurrentWatermarkMs()
        final = [r for r in runs if ends(r[1]) <= watermark]
        rest = runs[len(final) :]
        rows = []
        for first, last in final:
            if before is not None:
                rows.append((key[0], GAP, before + 1, first - 1, first - before - 1))
            rows.append((key[0], RUN, first, last, last - first + 1))
            before = last
        state.update(([f for f, _ in rest], [b for _, b in rest], before))
        if rest:
            state.setTimeoutTimestamp(ends(rest[0][1]) - 1)
        yield pd.DataFrame(rows, columns=[entity, "kind", "first_step", "last_step", "steps"])

    timed = stream.select(entity, instant(stream, time).alias("_time")).filter(F.col(entity).isNotNull() & F.col("_time").isNotNull())
    stepped = timed.withColumn("_step", F.floor(F.unix_timestamp("_time") / step_seconds)).withWatermark("_time", delay)
    out = f"{entity} {kind}, kind string, first_step long, last_step long, steps long"
    return stepped.groupBy(entity).applyInPandasWithState(settle, out, "firsts array<long>, lasts array<long>, before long", "append", GroupStateTimeout.EventTimeTimeout)
