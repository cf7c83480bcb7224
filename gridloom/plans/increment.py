"""Silver by increments: what new loads of bronze change, and no more.

A load is what one ingest appended: its batch and time. Loads that silver holds are entered in a ledger (ops_refined_loads).

A reading changes its own row and, through filling, gaps and changes since the row before, those that follow, up to the next row with a
value of its own. So of each site that a load touches the rows from the last one before its first new hour up to that next row are read and derived
anew, the first with the filled value that it has. Only dates on which a row came out different are written, by dynamic partition overwrite. Late and restated
readings go the same way as new ones. Searches before and after look at a week first, and beyond it only for sites that had no row there.

Of sites all versions of those with new snapshots are made anew and replaced together, so a version that a late snapshot undoes goes. The other feeds are
hours of a few regions and are made anew when they have loads. Running an increment again gives the same tables: the ledger is written last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.context import RunContext
from gridloom.plans import refine
from gridloom.sources import storage
from gridloom.sources.scratch import materialise

LOAD = ["_batch_id", "_ingested_at"]
DAYS = 7


def new_loads(spark: SparkSession, ctx: RunContext, feed: str) -> DataFrame:
    """The loads of a feed that silver doesn't hold."""
    loads = spark.table(ctx.table("bronze", feed)).select(*LOAD).distinct()
    done = spark.table(ctx.table("ops", "refined_loads")).filter(F.col("feed") == feed)
    return loads.join(done, LOAD, "left_anti")


def enter_loads(loads: DataFrame, ctx: RunContext, feed: str) -> None:
    storage.append(loads.select(F.lit(feed).alias("feed"), *LOAD).coalesce(1), ctx.table("ops", "refined_loads"), ctx)


def _nearest(silver: DataFrame, reach: DataFrame, found: dict, near: str) -> DataFrame:
    """site_id and what found makes of its rows; of dates for which near holds, and beyond them for sites that have none there."""
    of = lambda rows, sites: rows.join(sites, "site_id").filter(found["where"]).groupBy("site_id").agg(found["take"])
    first, _ = materialise(of(silver.filter(near), reach), "nearest")
    return first.unionByName(of(silver.filter(f"not ({near})"), reach.join(first, "site_id", "left_anti")))


def changed_readings(silver: DataFrame, raw: DataFrame) -> DataFrame:
    """The rows of silver readings that differ, or come to be, once raw, which it doesn't hold yet, is in it."""
    valid, _ = refine.checked_readings(raw)
    new, _ = materialise(refine.hourly(valid), "new-hours")
    reach, _ = materialise(new.groupBy("site_id").agg(F.min("reading_hour").alias("low"), F.max("reading_hour").alias("high")), "reach")
    ends = reach.agg(F.to_date(F.min("low")).alias("low"), F.to_date(F.max("high")).alias("high")).first()
    if ends.low is None:
        return silver.limit(0)
    hour = F.col("reading_hour")
    before = _nearest(silver, reach, {"where": hour < F.col("low"), "take": F.max_by(F.struct(hour.alias("from"), F.col("kwh_filled").alias("settled")), hour).alias("b")}, f"reading_date between date'{ends.low}' - {DAYS} and date'{ends.high}'")
    after = _nearest(silver.filter("kwh_consumed is not null"), reach, {"where": hour > F.col("high"), "take": F.min(hour).alias("until")}, f"reading_date between date'{ends.low}' and date'{ends.high}' + {DAYS}")
    span, _ = materialise(reach.join(before.select("site_id", "b.*"), "site_id", "left").join(after, "site_id", "left"), "span")
    dates = span.agg(F.to_date(F.min(F.coalesce("from", "low"))).alias("low"), F.when(F.count("until") == F.count(F.lit(1)), F.to_date(F.max("until"))).alias("high")).first()
    pruned = silver.filter(F.col("reading_date") >= F.lit(dates.low)) if dates.high is None else silver.filter(F.col("reading_date").between(F.lit(dates.low), F.lit(dates.high)))
    old = pruned.join(span, "site_id").filter((hour >= F.coalesce("from", "low")) & (F.col("until").isNull() | (hour <= F.col("until"))))
    old, _ = materialise(old.withColumn("is_settled", hour == F.col("from")).select(*silver.columns, "is_settled", F.when(hour == F.col("from"), F.col("settled")).alias("settled")), "old-hours")
    columns = new.columns
    merged = refine.latest_per_key(old.filter("is_settled is not true").select(*columns).unionByName(new), ["site_id", "reading_hour"], refine.newest(F.desc("reading_id")))
    with_first = merged.withColumns({"settled": F.lit(None).cast("double"), "is_settled": F.lit(False)}).unionByName(old.filter("is_settled").select(*columns, "settled", "is_settled"))
    derived = refine.with_neighbours(with_first, "settled").filter("not is_settled").select(*silver.columns)
    return derived.exceptAll(old.select(*silver.columns))


def refresh_readings(spark: SparkSession, ctx: RunContext) -> list:
    """Bring silver readings up to date; the dates that were written."""
    name, rejects = ctx.table("silver", "meter_readings"), ctx.table("ops", "rejected_readings")
    loads, _ = materialise(new_loads(spark, ctx, "meter_readings"), "loads")
    if loads.isEmpty():
        return []
    raw = spark.table(ctx.table("bronze", "meter_readings")).join(F.broadcast(loads), LOAD, "left_semi")  # a row for each ingest
    silver = spark.table(name)
    changed, _ = materialise(changed_readings(silver, raw), "changed")
    dates = sorted(r[0] for r in changed.select("reading_date").distinct().collect())
    if dates:
        kept = silver.filter(F.col("reading_date").isin(dates)).join(changed.select("site_id", "reading_hour"), ["site_id", "reading_hour"], "left_anti")
        whole, _ = materialise(kept.select(*silver.columns).unionByName(changed), "dates")  # a table that is read can't be written over
        storage.replace_partitions(whole.hint("rebalance", "reading_date"), name)
    _, rejected = refine.checked_readings(raw)
    held = spark.table(rejects).select(*LOAD).distinct()  # where an earlier call broke off before the ledger
    storage.append(rejected.join(held, LOAD, "left_anti").select(*spark.table(rejects).columns), rejects, ctx)
    enter_loads(loads, ctx, "meter_readings")
    return dates


def refresh_sites(spark: SparkSession, ctx: RunContext) -> None:
    loads, _ = materialise(new_loads(spark, ctx, "sites"), "loads")
    if loads.isEmpty():
        return
    raw = spark.table(ctx.table("bronze", "sites"))
    site = refine.c.trimmed("site_id")
    touched = raw.join(F.broadcast(loads), LOAD, "left_semi").select(site.alias("_site")).distinct()
    versions = refine.sites(raw.join(touched, site == F.col("_site"), "left_semi"))
    storage.upsert(spark, versions, ctx.table("silver", "sites"), ["site_id"], ctx, repeated=True)
    enter_loads(loads, ctx, "sites")


def refresh_whole(spark: SparkSession, ctx: RunContext, feed: str, build) -> None:
    """A feed that is made anew when it has loads."""
    loads, _ = materialise(new_loads(spark, ctx, feed), "loads")
    if not loads.isEmpty():
        storage.replace(build(spark.table(ctx.table("bronze", feed))), ctx.table("silver", feed), ctx)
        enter_loads(loads, ctx, feed)
