"""Operators that rank rows within groups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.scratch import materialise


def ranks(group: Sequence[str], order: Column, ties: Sequence[str | Column] = ()) -> dict[str, Column]:
    """rank and dense_rank with gaps and ties, row_number with ties broken."""
    w = Window.partitionBy(*group)
    return {"rank": F.rank().over(w.orderBy(order)), "dense_rank": F.dense_rank().over(w.orderBy(order)), "row_number": F.row_number().over(w.orderBy(order, *ties))}


def spread(group: Sequence[str], order: Column, tiles: int, ties: Sequence[str | Column] = (), scale: int = 4) -> dict[str, Column]:
    """percent_rank and cume_dist, and the tile of each row with ties broken; for groups that a task can sort, such as the hours of a month."""
    w = Window.partitionBy(*group)
    return {"percent_rank": F.round(F.percent_rank().over(w.orderBy(order)), scale), "cume_dist": F.round(F.cume_dist().over(w.orderBy(order)), scale), "tile": F.ntile(tiles).over(w.orderBy(order, *ties))}


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """df with row_number() per group in the column name, for groups of any size: no task sees more than a range of the order.

    Rows are dealt out by ranges of (group, order), sorted there and written with their place; what each range holds of each group is
    counted, and a running sum over the ranges (their number, whatever the input) gives the offset. The order should tell all rows
    apart, so that ranges come out even; rows that it doesn't are numbered in some order.
    """
    keys = [F.col(g).asc_nulls_first() for g in group]
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    placed, _ = materialise(placed.withColumn("_range", F.shiftright("_at", 33)), "numbered")
    held = placed.groupBy("_range", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("_range", *(F.col(g).alias(f"_g_{g}") for g in group), (F.col("_first") - F.coalesce(F.sum("_rows").over(before), F.lit(0)) - 1).alias("_shift"))
    same = placed["_range"] == offsets["_range"]
    for g in group:
        same &= placed[g].eqNullSafe(offsets[f"_g_{g}"])
    return placed.join(offsets, same).select(*(placed[c] for c in df.columns), (F.col("_at") - F.col("_shift")).alias(name))


@dataclass(frozen=True)
class Places:
    """Columns of a frame whose rows were placed by value within groups; see place_by."""

    nth: Column
    below: Column
    same: Column
    values_below: Column
    values: Column
    rows: Column

    @property
    def rank_down(self) -> Column:
        """rank() from the largest value."""
        return self.rows - self.below - self.same + 1

    @property
    def dense_rank_down(self) -> Column:
        return self.values - self.values_below

    @property
    def row_number_down(self) -> Column:
        """row_number() from the largest value, ties in their order upwards."""
        return self.rows - self.below - self.same + self.nth - self.below

    @property
    def percent_rank(self) -> Column:
        return F.when(self.rows > 1, self.below / (self.rows - 1)).otherwise(F.lit(0.0))

    @property
    def cume_dist(self) -> Column:
        return (self.below + self.same) / self.rows

    def tile(self, tiles: int) -> Column:
        """ntile(): the first rows % tiles tiles have one row more."""
        least, more = F.floor(self.rows / tiles), self.rows % tiles
        wide = more * (least + 1)
        return F.when(self.nth <= wide, F.floor((self.nth - 1) / (least + 1)) + 1).otherwise(more + F.floor((self.nth - 1 - wide) / F.greatest(least, F.lit(1))) + 1).cast("int")

    def share_reached(self, share: float) -> Column:
        """Whether this row is the first that at least so large a share of its group's rows doesn't exceed; the share is taken as it is written."""
        return self.nth == F.ceil(self.rows.cast("decimal(19,0)") * F.lit(Decimal(str(share))))


def place_by(df: DataFrame, group: Sequence[str], value: str, ties: Sequence[str | Column], tag: str) -> tuple[DataFrame, Places]:
    """df and its rows' places by value within their groups, nulls lowest, for groups and ties of any size.

    No window sees a group: rows are numbered within ranges, and so are the distinct values, of which a first aggregation makes one row each.
    A value that many rows share is one key of a join then, which Spark splits.
    """
    c = lambda name: f"_{tag}_{name}"
    lowest = F.col(value).asc_nulls_first()
    rows = numbered(df, group, [lowest, *ties], c("nth"))
    ties_ = rows.groupBy(*group, value).agg((F.min(c("nth")) - 1).alias(c("below")), F.count(F.lit(1)).alias(c("same")))
    values = numbered(ties_, group, [lowest], c("value"))
    whole = values.groupBy(*group).agg(F.max(c("value")).alias(c("values")), F.sum(c("same")).alias(c("rows")))
    out = _joined(_joined(rows, values, [*group, value]), whole, group)
    at = lambda name: F.col(c(name))
    return out, Places(at("nth"), at("below"), at("same"), at("value") - 1, at("values"), at("rows"))


def _joined(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """left with right's other columns where all of on agree, null with null."""
    named = right.withColumnsRenamed({k: f"_on_{k}" for k in on})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in on), F.lit(True))
    return left.join(named, same).drop(*(f"_on_{k}" for k in on))


def quantiles(df: DataFrame, group: Sequence[str], value: str, at: dict[str, float], rows: str) -> DataFrame:
    """Per group its rows and, for each share, the least value that at least so many of its values don't exceed; nulls are no values.

    Exact in groups of any size: values are numbered within ranges and counted off, so no task sees a group."""
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias(rows), F.count(value).alias("_values"))
    nth = _joined(numbered(df.select(*group, value), group, [F.asc_nulls_last(value)], "_nth"), counts, group)
    wanted = {k: F.ceil(F.col("_values").cast("decimal(19,0)") * F.lit(Decimal(str(q)))) for k, q in at.items()}
    return nth.groupBy(*group).agg(*(F.max(F.when(F.col("_nth") == n, F.col(value))).alias(k) for k, n in wanted.items()), F.max(rows).alias(rows))
