"""Operators on series: rows of an entity in order of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def along(entity: str | Sequence[str], time: str | Sequence[str | Column]) -> WindowSpec:
    listed = lambda x: [x] if isinstance(x, str | Column) else list(x)
    return Window.partitionBy(*listed(entity)).orderBy(*listed(time))


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def last_n(w: WindowSpec, n: int) -> WindowSpec:
    """This row and the n - 1 before it."""
    return w.rowsBetween(1 - n, 0)


def before(w: WindowSpec, n: int) -> WindowSpec:
    """The n rows before this one."""
    return w.rowsBetween(-n, -1)


def whole(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def forward_filled(value: Column, w: WindowSpec) -> Column:
    return F.coalesce(value, F.last(value, ignorenulls=True).over(so_far(w)))


def last_days(entity: str, day: str, days: int) -> WindowSpec:
    """Rows of the last so many calendar days, whatever rows are missing."""
    return Window.partitionBy(entity).orderBy(F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))).rangeBetween(1 - days, 0)


def islands(df: DataFrame, entity: str, step: Column) -> DataFrame:
    """Runs of consecutive steps: entity, first_step, last_step, steps. Each (entity, step) comes once at most."""
    nth = F.row_number().over(Window.partitionBy(entity).orderBy("_step"))
    return (
        df.select(entity, step.alias("_step"))
        .withColumn("_island", F.col("_step") - nth)
        .groupBy(entity, "_island")
        .agg(F.min("_step").alias("first_step"), F.max("_step").alias("last_step"), F.count(F.lit(1)).alias("steps"))
        .drop("_island")
    )


def z_scored(df: DataFrame, value: str, w: WindowSpec, rows: int, least: int, scale: int = 3) -> DataFrame:
    """df with baseline_mean, baseline_stddev, baseline_rows over the rows before each, and z_score where the baseline suffices."""
    past = before(w, rows)
    out = df.withColumns({
        "baseline_mean": F.avg(value).over(past),
        "baseline_stddev": F.stddev_samp(value).over(past),
        "baseline_rows": F.count(value).over(past),
    })
    fit = (F.col("baseline_rows") >= least) & (F.col("baseline_stddev") > 0)
    return out.withColumn("z_score", F.when(fit, F.round(F.try_divide(F.col(value) - F.col("baseline_mean"), F.col("baseline_stddev")), scale)))
