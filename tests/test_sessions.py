"""Streamed runs and gaps against those of a batch."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gridloom.operators import series
from gridloom.streaming.sessions import instant, merged, runs_and_gaps

START = datetime(2025, 1, 1)
HOUR = int(START.timestamp()) // 3600


def test_runs_merge():
    r = random.Random(1)
    for _ in range(200):
        steps = [r.randrange(30) for _ in range(r.randrange(25))]
        k = r.randrange(len(steps) + 1)
        got = merged(merged([], steps[:k]), steps[k:])
        assert [s for a, b in got for s in range(a, b + 1)] == sorted(set(steps)) and all(b[0] > a[1] + 1 for a, b in zip(got, got[1:]))


def test_streamed_runs_equal_islands(spark, tmp_path):
    """Many batches, rows out of order within the delay, repeated hours, a restart between batches: what is final is what a batch finds."""
    r = random.Random(5)
    hours = [(s, h) for s in ("a", "b", "c") for h in range(240) if r.random() < (0.5 if s == "c" else 0.85)]
    rows = sorted(((s, START + timedelta(hours=h, minutes=r.randrange(60))) for s, h in hours + hours[::9]), key=lambda x: x[1] + timedelta(hours=r.randrange(10)))
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")

    def land(part):
        spark.createDataFrame(part, "site string, ts timestamp").coalesce(1).write.mode("append").parquet(folder)

    def drain():
        stream = spark.readStream.schema("site string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
        runs_and_gaps(stream, "site", "ts", "12 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    n = len(rows)
    for a, b in ((0, n // 4), (n // 4, n // 2)):
        land(rows[a:b])
    drain()
    land(rows[n // 2 :] + [(None, START), ("a", None)])
    drain()  # another query, from the checkpoint
    land([("a", START)])  # far too late
    drain()
    got = spark.read.parquet(out).collect()
    watermark = max(t for _, t in rows).timestamp() - 12 * 3600
    whole = spark.createDataFrame(rows, "site string, ts timestamp").select("site", F.floor(F.unix_timestamp("ts") / 3600).alias("step")).distinct()
    islands = [r for r in series.islands(whole, "site", F.col("step")).collect() if (r.last_step + 2) * 3600 <= watermark]
    assert sorted((r.site, r.first_step, r.last_step, r.steps) for r in got if r.kind == "run") == sorted(map(tuple, islands)) and len(islands) > 60
    held = set(map(tuple, whole.collect()))
    for site in "abc":
        runs = sorted(r.first_step for r in got if r.kind == "run" and r.site == site)
        missing = [h for h in range(runs[0], runs[-1]) if (site, h) not in held]
        assert missing == [h for r in sorted(got, key=lambda r: r.first_step) if r.kind == "gap" and r.site == site for h in range(r.first_step, r.last_step + 1)]


def test_times_without_zone_are_utc(spark, tmp_path):
    """A session's zone moves no step, not even where its clocks skip or repeat an hour; microseconds stay."""
    times = ["1969-12-31 23:59:59.999999", "1970-01-01 00:00:00.000001", "2024-03-10 02:30:00.123456", "2024-03-10 03:30:00", "2024-11-03 01:30:00", "2024-11-03 02:30:00", "2024-11-05 00:00:00"]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.createDataFrame([(t,) for t in times], "t string").select("t", F.col("t").cast("timestamp_ntz").alias("ts"), F.lit(1).alias("site"))
        for r in rows.select("t", F.unix_micros(instant(rows, "ts")).alias("us")).collect():
            assert r.us == (datetime.fromisoformat(r.t) - datetime(1970, 1, 1)) // timedelta(microseconds=1)
        rows.filter("t > '2024'").select("site", "ts").write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("site int, ts timestamp_ntz").parquet(str(tmp_path / "in"))
        out = str(tmp_path / "out")
        runs_and_gaps(stream, "site", "ts", "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        got = sorted((r.first_step, r.last_step) for r in spark.read.parquet(out).collect() if r.kind == "run")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    step = lambda *at: (datetime(*at) - datetime(1970, 1, 1)) // timedelta(hours=1)
    assert got == [(step(2024, 3, 10, 2), step(2024, 3, 10, 3)), (step(2024, 11, 3, 1), step(2024, 11, 3, 2))]
