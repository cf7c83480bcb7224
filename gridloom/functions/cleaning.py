"""Column expressions that turn raw text into typed values; under ANSI rules bad text becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(c: str) -> Column:
    return F.col(c).try_cast("double")


def to_timestamp(c: str) -> Column:
    return F.try_to_timestamp(F.col(c))


def to_day(c: str) -> Column:
    return to_timestamp(c).cast("date")


def to_hour(c: str) -> Column:
    return F.date_trunc("hour", to_timestamp(c))


def trimmed(c: str) -> Column:
    return F.trim(F.col(c))


def lowered(c: str) -> Column:
    return F.lower(trimmed(c))


def raised(c: str) -> Column:
    return F.upper(trimmed(c))


def month_of(c: Column) -> Column:
    return F.trunc(c.cast("date"), "month")


def hour_index(c: Column) -> Column:
    """Hours since 1970-01-01T00 of a timestamp's wall clock."""
    return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(c)


def is_weekend(c: Column) -> Column:
    return F.dayofweek(c).isin(1, 7)
