"""Ratios and statistics that give null instead of an error where a denominator is zero."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def share_pct(part: Column, whole: Column, scale: int = 2) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, scale))


def pct_change(now: Column, before: Column, scale: int = 2) -> Column:
    return F.when(before != 0, F.round((now - before) / F.abs(before) * 100, scale))


def moments(x: Column, y: Column) -> Column:
    """Means, variances and covariance of pairs as one aggregate, from which a Line has all that it says."""
    return F.struct(F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.var_samp(x).alias("var_x"), F.var_samp(y).alias("var_y"), F.covar_samp(x, y).alias("covar"))


@dataclass(frozen=True)
class Line:
    """The line of least squares through pairs, from a column that moments() made; what a constant series leaves open is null."""

    of: Column

    @property
    def covariance(self) -> Column:
        return self.of["covar"]

    @property
    def rise(self) -> Column:
        return F.try_divide(self.of["covar"], self.of["var_x"])

    @property
    def at_zero(self) -> Column:
        return self.of["mean_y"] - self.rise * self.of["mean_x"]

    @property
    def fit(self) -> Column:
        """The pairs' correlation."""
        return F.try_divide(self.of["covar"], F.sqrt(self.of["var_x"]) * F.sqrt(self.of["var_y"]))
