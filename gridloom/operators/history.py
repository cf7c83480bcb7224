"""Type-2 history: snapshots become versions that are valid over [valid_from, valid_to), and facts find theirs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.keys import latest_per_key
from gridloom.sources.scratch import materialise

#: Versions of one key up to which a fact is compared with all of its key's.
FEW = 256


def fingerprint(columns: Sequence[str]) -> Column:
    return F.sha2(F.concat_ws("||", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def to_versions(snapshots: DataFrame, key: str, effective: str, tracked: Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    """One row per change of the tracked columns: attr_hash, valid_from, valid_to (null while open), is_current, version."""
    series = Window.partitionBy(key).orderBy(effective)
    hashed = latest_per_key(snapshots, [key, effective], newest_first).withColumn("attr_hash", fingerprint(tracked))
    changed = hashed.withColumn("_before", F.lag("attr_hash").over(series)).filter("_before is null or _before != attr_hash").drop("_before")
    return changed.withColumns({"valid_to": F.lead(effective).over(series), "version": F.row_number().over(series)}).select(
        key, *tracked, "attr_hash", F.col(effective).alias("valid_from"), "valid_to", F.col("valid_to").isNull().alias("is_current"), "version"
    )


def as_of_join(facts: DataFrame, versions: DataFrame, key: str, day: Column, take: dict[str, str]) -> DataFrame:
    """facts, each with the columns taken (name there: name here) from the version valid on its day; nulls where there is none.

    An equi-join on the key with the interval as residual condition, for keys of few versions; see as_of_by_ranges for others.
    """
    right = versions.select(F.col(key).alias("_key"), F.col("valid_from").alias("_from"), F.coalesce("valid_to", F.lit("9999-12-31").cast("date")).alias("_to"), *(F.col(a).alias(b) for a, b in take.items()))
    left = facts.withColumn("_day", day)
    return left.join(right, (left[key] == right["_key"]) & (left["_day"] >= right["_from"]) & (left["_day"] < right["_to"]), "left").drop("_key", "_from", "_to", "_day")


def as_of_by_ranges(facts: DataFrame, versions: DataFrame, key: str, at: Column, take: dict[str, str]) -> DataFrame:
    """The same for keys of any number of versions and facts, where versions of a key don't overlap and valid_from is of at's type.

    Versions and facts are put into one order by key and time, dealt out by ranges of it, and each fact takes the last version before it: within its range, or,
    where that has none of its key, the last of the ranges before, of which only the ends are looked at. So no fact is compared with more than one version, and a
    key's rows are in as many tasks as they fill.
    """
    chosen = F.struct(F.coalesce("valid_to", F.lit("9999-12-31").cast(dict(versions.dtypes)["valid_from"])).alias("_to"), *(F.col(a).alias(b) for a, b in take.items()))
    given = versions.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col("valid_from").alias("_at"), F.lit(0).alias("_kind"), chosen.alias("_version"))
    asking = facts.select(F.col(key).alias("_key"), at.alias("_at"), F.lit(1).alias("_kind"), F.struct(*facts.columns).alias("_fact"))
    rows = given.unionByName(asking, allowMissingColumns=True).withColumn("_tie", F.xxhash64("_fact"))
    order = ["_key", "_at", "_kind", "_tie"]
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt, _ = materialise(dealt, "as-of")
    so_far = Window.partitionBy("_range", "_key").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = dealt.withColumn("_found", F.last("_version", ignorenulls=True).over(so_far)).filter("_kind = 1")
    ends = dealt.groupBy("_range", "_key").agg(F.max_by("_version", F.when(F.col("_kind") == 0, F.col("_at"))).alias("_end"))
    earlier = F.last("_end", ignorenulls=True).over(Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    before = ends.select(F.col("_range").alias("_r"), F.col("_key").alias("_k"), earlier.alias("_before")).filter("_before is not null")
    joined = within.join(before, (F.col("_range") == F.col("_r")) & (F.col("_key") == F.col("_k")), "left").withColumn("_found", F.coalesce("_found", "_before"))
    valid = (F.col("_at") < F.col("_found._to")) & F.col("_key").isNotNull()
    return joined.select("_fact.*", *(F.when(valid, F.col(f"_found.{b}")).alias(b) for b in take.values()))


def most_versions(versions: DataFrame, key: str) -> int:
    return versions.groupBy(key).count().agg(F.max("count")).first()[0] or 0


def broken_chains(versions: DataFrame, key: str) -> DataFrame:
    """Closed versions that don't end where the next begins."""
    follows = F.lead("valid_from").over(Window.partitionBy(key).orderBy("valid_from"))
    return versions.withColumn("next_from", follows).filter("valid_to != next_from")


def not_one_current(versions: DataFrame, key: str) -> DataFrame:
    return versions.groupBy(key).agg(F.sum(F.col("is_current").cast("int")).alias("current")).filter("current != 1")
