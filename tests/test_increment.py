"""Silver by increments against silver from all of bronze."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gridloom.context import RunContext
from gridloom.plans import increment, pipeline, refine
from gridloom.sources import storage
from gridloom.sources.feeds import FEEDS
from tests.conftest import raw

DAY = datetime(2025, 1, 1)


def _reading(r, i):
    at = DAY + timedelta(hours=r.randrange(24 * 25), minutes=r.randrange(60))
    site = r.choice(["S1", "S1", "S1", " S2 ", "S3", "S4" if i > 300 else "S3", None if i % 40 == 0 else "S2"])
    value = r.choice(["1.5", "2", "0", None, None, None, "-1" if i % 7 == 0 else "3"])
    return (f"R{i % 350}", site, "nonsense" if i % 61 == 0 else at.isoformat(), value, None, "230", r.choice(["ok", "restated"]))


def _load(spark, ctx, feed, rows, at):
    batch = raw(spark, feed, [(*row, at) for row in rows]).withColumn("_batch_id", F.lit(f"b{at.minute}"))
    storage.append(batch, ctx.table("bronze", feed), ctx)


def _site(site, tariff, day):
    return (site, "n", "north", "residential", tariff, "5", day)


def _rows(df):
    return sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect())))


def test_increments_equal_a_rebuild(spark, ctx):
    r = random.Random(11)
    loads = [[_reading(r, i) for i in range(a, b)] for a, b in ((0, 250), (250, 270), (270, 271), (271, 271), (271, 420))]
    snapshots = [[_site("S1", "flat", "2024-01-01"), _site("S1", "dynamic", "2024-03-01"), _site("S2", "flat", "2024-01-01")], [], [_site("S1", "dynamic", "2024-02-01")], [], [_site("S9", "flat", "2024-01-01"), _site("S2", "flat", "2024-05-01")]]
    for feed in FEEDS:
        _load(spark, ctx, feed, [], DAY)
    for n, (rows, sites) in enumerate(zip(loads, snapshots)):
        at = datetime(2025, 2, 1, 0, n)
        _load(spark, ctx, "meter_readings", rows, at)
        _load(spark, ctx, "sites", sites, at)
        if n == 4:
            _load(spark, ctx, "prices", [("north", "2025-01-01T00:00:00", "5", "day_ahead")], at)
        pipeline.run_silver(spark, ctx)
        bronze = lambda feed: spark.table(ctx.table("bronze", feed))
        assert _rows(spark.table(ctx.table("silver", "meter_readings"))) == _rows(refine.readings(bronze("meter_readings"))), n
        assert _rows(spark.table(ctx.table("silver", "sites"))) == _rows(refine.sites(bronze("sites"))), n
        assert _rows(spark.table(ctx.table("ops", "rejected_readings"))) == _rows(refine.checked_readings(bronze("meter_readings"))[1]), n
    assert spark.table(ctx.table("silver", "prices")).count() == 1
    current = spark.table(ctx.table("silver", "sites")).filter("site_id = 'S1'").orderBy("version").collect()
    assert [(v.tariff_plan, str(v.valid_from)) for v in current] == [("flat", "2024-01-01"), ("dynamic", "2024-02-01")]  # the late snapshot undid the version of March


def test_only_dates_that_change_are_written(spark, ctx):
    for feed in FEEDS:
        _load(spark, ctx, feed, [], DAY)
    hours = [(f"R{s}{h}", f"S{s}", (DAY + timedelta(hours=h)).isoformat(), None if 50 <= h < 60 or h == 100 else "1", "0", "230", "ok") for s in range(3) for h in range(24 * 10) if h != 90]
    _load(spark, ctx, "meter_readings", hours, DAY)
    pipeline.run_silver(spark, ctx)
    name = ctx.table("silver", "meter_readings")
    files = lambda: {f.split("reading_date=")[1].split("/")[0]: f for f in spark.table(name).inputFiles()}
    before = files()
    _load(spark, ctx, "meter_readings", [("late", "S1", (DAY + timedelta(hours=47)).isoformat(), "8", "0", "230", "restated")], datetime(2025, 2, 1, 0, 1))
    assert [str(d) for d in increment.refresh_readings(spark, ctx)] == ["2025-01-02", "2025-01-03"]  # the hour after has another row before it
    after = files()
    assert {d for d in before if after.get(d) != before[d]} == {"2025-01-02", "2025-01-03"} and len(after) == len(before) == 10
    assert increment.refresh_readings(spark, ctx) == []
    again = [("same", "S2", (DAY + timedelta(hours=5)).isoformat(), "1", "0", "230", "ok")]
    _load(spark, ctx, "meter_readings", again, datetime(2024, 1, 1))  # older than what is there
    assert increment.refresh_readings(spark, ctx) == [] and increment.new_loads(spark, ctx, "meter_readings").isEmpty()
    assert _rows(spark.table(name)) == _rows(refine.readings(spark.table(ctx.table("bronze", "meter_readings"))))


def test_an_increment_that_broke_off_runs_again(spark, ctx, monkeypatch):
    for feed in FEEDS:
        _load(spark, ctx, feed, [], DAY)
    pipeline.run_silver(spark, ctx)
    _load(spark, ctx, "meter_readings", [("a", "S1", "2025-01-01T00:10:00", "1", "0", "230", "ok"), ("b", None, "2025-01-01T00:10:00", "1", "0", "230", "ok")], DAY)
    with monkeypatch.context() as m:
        m.setattr(increment, "enter_loads", lambda *_: 1 / 0)
        try:
            increment.refresh_readings(spark, ctx)
        except ZeroDivisionError:
            pass
    increment.refresh_readings(spark, RunContext(ctx.schema, ctx.landing))
    assert spark.table(ctx.table("silver", "meter_readings")).count() == 1 and spark.table(ctx.table("ops", "rejected_readings")).count() == 1
