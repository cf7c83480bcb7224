"""Grouping sets and pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefix_sets(df: DataFrame, always: Sequence[str], levels: Sequence[str], measures: dict[str, str]) -> DataFrame:
    """Aggregates at every prefix of levels, from all of them to none; grouping_level is the grouping id of levels.

    measures maps output names to SQL aggregates. Rows expand once per prefix before a partial aggregation, so df should hold sums
    of all levels and of what is counted distinct, not single readings.
    """
    sets = ", ".join("(" + ", ".join([*always, *levels[:n]]) + ")" for n in range(len(levels), -1, -1))
    text = f"""
      SELECT {", ".join([*always, *levels])}, grouping_id({", ".join([*always, *levels])}) AS grouping_level,
        {", ".join(f"{sql} AS {name}" for name, sql in measures.items())}
      FROM {{source}} GROUP BY GROUPING SETS ({sets})
    """
    return df.sparkSession.sql(text, source=df)


def pivot_sums(keys: Sequence[str], category: str, values: Sequence[str], measure: Column, suffix: str) -> list[Column]:
    """A sum for each category as aggregates of one groupBy over keys: null, not 0, where a category is absent.

    Conditional sums take one shuffle; pivot() would take two and a join back.
    """
    return [F.sum(F.when(F.col(category) == v, measure)).alias(f"{v}{suffix}") for v in values]
