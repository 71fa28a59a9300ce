"""Moments and quantiles with defined values on degenerate input, and the normal quantile."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Variances below this count as none.
TINY = 1e-15

#: Coefficients of Abramowitz and Stegun 26.2.23, numerator and denominator.
_TAIL = (2.515517, 0.802853, 0.010328), (1.432788, 0.189269, 0.001308)


def norm_ppf(p: float) -> float:
    """Quantile of the standard normal distribution by a rational approximation; 0 outside (0, 1)."""
    if not 0 < p < 1:
        return 0.0
    t = math.sqrt(-2 * math.log(min(p, 1 - p)))
    (c0, c1, c2), (d1, d2, d3) = _TAIL
    z = t - (c0 + t * (c1 + t * c2)) / (1 + t * (d1 + t * (d2 + t * d3)))
    return z if p > 0.5 else -z


def skew(x: Column) -> Column:
    """Population skewness."""
    return F.skewness(x)


def excess(x: Column) -> Column:
    """Population excess kurtosis."""
    return F.kurtosis(x)


def moments_or_zero(moment: Column, variance: Column) -> Column:
    """``moment``, and 0 where the variance is nil."""
    return F.when(variance < TINY, 0.0).otherwise(F.coalesce(moment, F.lit(0.0)))
