"""Risk measures. Without a window: one row per symbol. With one: a column of the bar table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import TINY, moments_or_zero, norm_ppf
from ..functions.windows import TRADING_DAYS, add, change, check_window, div, full, keys, series, trailing, upto

METHODS = ("historical", "parametric", "cornish_fisher")
_YEAR = math.sqrt(TRADING_DAYS)
_INF = float("inf")


def _with_returns(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("__ret", change(df, column))


def _enough(df: DataFrame, window: int, least: int) -> Column:
    """Past the first ``window`` rows, with ``least`` returns in the frame."""
    return (F.row_number().over(series(df)) > window) & (F.count("__ret").over(trailing(df, window)) >= least)


def _per_symbol(df: DataFrame, **columns: Column) -> DataFrame:
    return df.groupBy(*keys(df)).agg(*[c.alias(n) for n, c in columns.items()])


def sharpe_ratio(df: DataFrame, window: int | None = None, risk_free_rate: float = 0.0, column: str = "close") -> DataFrame:
    """Annual mean excess return over sample deviation. Per symbol: 0 without returns or deviation. Rolling: ``sharpe_{window}``."""
    daily = risk_free_rate / TRADING_DAYS
    out = _with_returns(df, column).withColumn("__ret", F.col("__ret") - daily)
    if window is None:
        dev = F.stddev_samp("__ret")
        return _per_symbol(out, sharpe=F.when(dev >= TINY, F.avg("__ret") / dev * _YEAR).otherwise(0.0))
    w = trailing(out, check_window(window, 2))
    return add(out, {f"sharpe_{window}": div(full(F.avg("__ret"), "__ret", w, window), full(F.stddev_samp("__ret"), "__ret", w, window)) * _YEAR}).drop("__ret")


def _sortino(mean: Column, dev: Column, n_down: Column) -> Column:
    flat = (n_down < 2) | F.coalesce(dev < TINY, F.lit(True))
    return F.when(flat, F.when(mean > 0, _INF).otherwise(0.0)).otherwise(mean / F.nullif(dev, F.lit(0.0)) * _YEAR)


def sortino_ratio(df: DataFrame, window: int | None = None, risk_free_rate: float = 0.0, column: str = "close") -> DataFrame:
    """As Sharpe's, over the sample deviation of negative returns; with fewer than two of them, infinite for a gain and else 0."""
    daily = risk_free_rate / TRADING_DAYS
    out = _with_returns(df, column).withColumn("__ret", F.col("__ret") - daily)
    down = F.when(F.col("__ret") < 0, F.col("__ret"))
    if window is None:
        return _per_symbol(out, sortino=_sortino(F.avg("__ret"), F.stddev_samp(down), F.count(down)))
    w = trailing(out, check_window(window, 2))
    value = _sortino(F.avg("__ret").over(w), F.stddev_samp(down).over(w), F.count(down).over(w))
    return add(out, {f"sortino_{window}": F.when(_enough(out, window, 2), value)}).drop("__ret")


def calmar_ratio(df: DataFrame, column: str = "close") -> DataFrame:
    """Annual return over the deepest drawdown, per symbol; fewer than two rows give 0, no drawdown infinity for a gain and else 0."""
    top = F.max(column).over(upto(df))
    out = df.withColumn("__dd", div(F.col(column) - top, top))
    first, last, n, deepest = F.min_by(column, "timestamp"), F.max_by(column, "timestamp"), F.count("*"), F.abs(F.min("__dd"))
    annual = F.pow(div(last, first), F.lit(float(TRADING_DAYS)) / n) - 1
    value = F.when(n < 2, 0.0).when(deepest < TINY, F.when(annual > 0, _INF).otherwise(0.0)).otherwise(div(annual, deepest))
    return _per_symbol(out, calmar=value)


def _quantile(share: float, accuracy: int | None) -> Column:
    """Of the returns: exact, which gathers the distinct values of a series, or by a sketch of bounded size."""
    return F.percentile("__ret", F.lit(share)) if accuracy is None else F.percentile_approx("__ret", F.lit(share), accuracy)


def _var(confidence: float, method: str, over=None, accuracy: int | None = None) -> Column:
    at = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    a = 1 - confidence
    if method == "historical":
        return at(_quantile(a, accuracy))
    mean, dev, z = at(F.avg("__ret")), at(F.stddev_pop("__ret")), norm_ppf(a)
    if method == "parametric":
        return mean + dev * z
    var = at(F.var_pop("__ret"))
    s, k = moments_or_zero(at(F.skewness("__ret")), var), moments_or_zero(at(F.kurtosis("__ret")), var)
    return mean + dev * (z + (z * z - 1) / 6 * s + (z**3 - 3 * z) / 24 * k - (2 * z**3 - 5 * z) / 36 * s * s)


def value_at_risk(df: DataFrame, confidence: float = 0.95, method: str = "historical", window: int | None = None, column: str = "close", accuracy: int | None = None) -> DataFrame:
    """The return that is undercut with probability 1 - confidence. Per symbol: 0 with fewer than two returns. Rolling: ``var_{window}``.

    ``accuracy``: for series too long to gather their values, the quantile's rank may be off by a share of 1 / accuracy.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    out = _with_returns(df, column)
    if window is None:
        return _per_symbol(out, var=F.when(F.count("__ret") < 2, 0.0).otherwise(_var(confidence, method, accuracy=accuracy)))
    value = _var(confidence, method, trailing(out, check_window(window)))
    return add(out, {f"var_{window}": F.when(_enough(out, window, 4), value)}).drop("__ret")


def cvar(df: DataFrame, confidence: float = 0.95, window: int | None = None, column: str = "close", accuracy: int | None = None) -> DataFrame:
    """Mean of the returns at or below the historical value at risk. Rolling: ``cvar_{window}``. ``accuracy``: as for ``value_at_risk``."""
    out = _with_returns(df, column)
    if window is None:
        level = out.groupBy(*keys(df)).agg(_quantile(1 - confidence, accuracy).alias("__q"))
        joined = out.join(level, keys(df)) if keys(df) else out.crossJoin(level)  # one row
        return _per_symbol(joined, cvar=F.when(F.count("__ret") < 2, 0.0).otherwise(F.coalesce(F.avg(F.when(F.col("__ret") <= F.col("__q"), F.col("__ret"))), F.lit(0.0))))
    w = trailing(out, check_window(window))
    out = out.withColumns({"__q": F.percentile("__ret", F.lit(1 - confidence)).over(w), "__all": F.collect_list("__ret").over(w)})
    below = F.filter("__all", lambda r: r <= F.col("__q"))
    mean = F.aggregate(below, F.lit(0.0), lambda acc, r: acc + r) / F.nullif(F.size(below).cast("double"), F.lit(0.0))
    return add(out, {f"cvar_{window}": F.when(_enough(out, window, 4), mean)}).drop("__ret", "__q", "__all")


def max_drawdown_duration(df: DataFrame, column: str = "close") -> DataFrame:
    """``dd_duration``: rows since the last high (a row equal to it counts as one); ``dd_max_duration``: its running maximum."""
    w = upto(df)
    out = df.withColumns({"__row": F.row_number().over(series(df)), "__top": F.max(column).over(w)})
    out = add(out, {"dd_duration": F.col("__row") - F.coalesce(F.max(F.when(F.col(column) >= F.col("__top"), F.col("__row"))).over(w), F.col("__row"))})
    return add(out, {"dd_max_duration": F.max("dd_duration").over(w)}).drop("__row", "__top")
