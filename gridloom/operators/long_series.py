"""Windows over series that a single task can't hold: one site with all rows, or a third of them.

Rows are numbered along their series within ranges (``ranking.numbered``) and cut into chunks by number. What looks a bounded number of rows back or
ahead gets these rows as copies in its chunk, a halo that goes again afterwards; what looks back without bound takes what the chunks before end with, one row
for each chunk. Runs of steps need no window at all: step minus number is the same along a run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridloom.operators.ranking import numbered
from gridloom.operators.series import so_far

CHUNK = 1 << 20
_WORK = ("_nth", "_chunk", "_halo")


def along_chunk(entity: Sequence[str]) -> WindowSpec:
    """The window for columns of a frame that in_chunks made."""
    return Window.partitionBy(*entity, "_chunk").orderBy("_nth")


def in_chunks(df: DataFrame, entity: Sequence[str], order: Sequence[str | Column], before: int = 0, after: int = 0, size: int = CHUNK) -> DataFrame:
    """df with _nth and _chunk, and copies, marked _halo, of so many rows before and after each chunk. The order must tell a series' rows apart."""
    if max(before, after) > size:
        raise ValueError(f"a halo of {max(before, after)} rows is wider than a chunk of {size}")
    place = F.pmod(F.col("_nth") - 1, F.lit(size))
    of = lambda shift, halo: F.struct((F.floor((F.col("_nth") - 1) / size) + shift).alias("_chunk"), F.lit(halo).alias("_halo"))
    homes = F.array(of(0, False), F.when(place >= size - before, of(1, True)), F.when(place < after, of(-1, True)))
    return numbered(df, entity, order, "_nth").withColumn("_home", F.explode(F.array_compact(homes))).select(*df.columns, "_nth", "_home.*")


def with_windows(df: DataFrame, entity: Sequence[str], order: Sequence[str | Column], columns: dict[str, Column], before: int, after: int = 0, size: int = CHUNK) -> DataFrame:
    """df with columns over along_chunk(entity) that look no further than before and after: lags, leads, moving aggregates."""
    return in_chunks(df, entity, order, before, after, size).withColumns(columns).filter("not _halo").drop(*_WORK)


def _with_carry(chunks: DataFrame, entity: Sequence[str], end: Column, carried: Column) -> DataFrame:
    """chunks with _carry: what the ends of the chunks before a row's own come to."""
    earlier = Window.partitionBy(*entity).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = chunks.groupBy(*entity, "_chunk").agg(end.alias("_end")).select(*(F.col(e).alias(f"_e_{e}") for e in entity), F.col("_chunk").alias("_c"), carried.over(earlier).alias("_carry"))
    same = F.col("_chunk") == F.col("_c")
    for e in entity:
        same &= F.col(e).eqNullSafe(F.col(f"_e_{e}"))
    return chunks.join(ends, same, "left").drop("_c", *(f"_e_{e}" for e in entity))


def forward_filled(df: DataFrame, entity: Sequence[str], order: Sequence[str | Column], value: str, name: str, size: int = CHUNK) -> DataFrame:
    """df with the last value so far that isn't null, however far back it is."""
    chunks = in_chunks(df, entity, order, size=size)
    end = F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_nth")))
    filled = F.coalesce(F.last(value, ignorenulls=True).over(so_far(along_chunk(entity))), "_carry")
    return _with_carry(chunks, entity, end, F.last("_end", ignorenulls=True)).withColumn(name, filled).drop("_carry", *_WORK)


def running_total(df: DataFrame, entity: Sequence[str], order: Sequence[str | Column], value: str, name: str, size: int = CHUNK) -> DataFrame:
    """df with the sum of a series' values so far; exact for whole numbers and decimals."""
    chunks = in_chunks(df, entity, order, size=size)
    inside = F.sum(value).over(so_far(along_chunk(entity)))
    total = F.when(inside.isNotNull() | F.col("_carry").isNotNull(), F.coalesce(inside, F.lit(0)) + F.coalesce("_carry", F.lit(0)))
    return _with_carry(chunks, entity, F.sum(value), F.sum("_end")).withColumn(name, total).drop("_carry", *_WORK)


def islands(df: DataFrame, entity: str, step: Column) -> DataFrame:
    """What series.islands gives: runs of consecutive steps, each (entity, step) once at most. Runs are put together by a partial aggregation."""
    rows = numbered(df.select(entity, step.alias("_step")), [entity], ["_step"], "_nth")
    runs = rows.groupBy(entity, (F.col("_step") - F.col("_nth")).alias("_run"))
    return runs.agg(F.min("_step").alias("first_step"), F.max("_step").alias("last_step"), F.count(F.lit(1)).alias("steps")).drop("_run")
