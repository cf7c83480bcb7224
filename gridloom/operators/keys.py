"""Operators on keys: the newest row of each, duplicates, rows that fail a rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order.

    A lone row_number() = 1 lets Spark drop losers before the shuffle, so a hot key sends few rows. Rows that tie are told apart by
    a hash of the whole row, so the choice never depends on how data are dealt out.
    """
    order = [*newest_first, F.xxhash64(*map(F.col, df.columns))]
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def split_rows(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows that break no rule, rows that do with reject_reason, the first rule broken). A rule that gives null isn't broken."""
    reason = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        reason = F.when(broken, F.lit(name)).otherwise(reason)
    marked = df.withColumn("reject_reason", reason)
    return marked.filter("reject_reason is null").drop("reject_reason"), marked.filter("reject_reason is not null")


def not_seen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those seen, in df's column order."""
    return df.join(seen.select(key).distinct(), key, "left_anti").select(*df.columns)
