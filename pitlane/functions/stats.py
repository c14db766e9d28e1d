"""Aggregate expressions with the guards the statistics need.

Every function takes columns and returns an aggregate column, so a whole
catalogue of metrics is one ``groupBy().agg()``. Undefined values are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitlane.functions.scalar import _c


def sample_std(x: Column | str) -> Column:
    """Sample deviation; 0 when fewer than two values."""
    return F.coalesce(F.stddev_samp(_c(x)), F.lit(0.0))


def sample_cov(x: Column | str, y: Column | str) -> Column:
    return F.covar_samp(_c(x), _c(y))


def nonzero_ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d)


def sharpe(x: Column | str) -> Column:
    """Mean over sample deviation; null with fewer than two values or no spread."""
    return nonzero_ratio(F.avg(_c(x)), F.stddev_samp(_c(x)))


def skewness(x: Column | str) -> Column:
    """Population skewness m3 / m2^1.5."""
    return F.when(F.count(_c(x)) >= 2, F.skewness(_c(x)))


def kurtosis(x: Column | str) -> Column:
    """Population kurtosis, normal = 3."""
    return F.when(F.count(_c(x)) >= 2, F.kurtosis(_c(x)) + 3.0)


def pearson(x: Column | str, y: Column | str, min_n: int = 2) -> Column:
    """Correlation that is null, not an error, when a side is constant."""
    sx, sy = F.stddev_samp(_c(x)), F.stddev_samp(_c(y))
    return F.when(F.count(F.lit(1)) >= min_n, nonzero_ratio(F.covar_samp(_c(x), _c(y)), sx * sy))
