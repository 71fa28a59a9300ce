"""Rolling statistics of prices and distribution statistics of returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import TINY, moments_or_zero
from ..functions.windows import add, change, check_window, div, full, many, series, trailing

STATS = ("mean", "std", "min", "max", "skew", "zscore")


def rolling_stats(df: DataFrame, windows: int | Sequence[int] = 21, column: str = "close", stats: Sequence[str] | None = None) -> DataFrame:
    """``rolling_{stat}_{w}`` of the column: mean, std (sample), min, max, skew (population), zscore."""
    stats = ["mean", "std"] if stats is None else list(stats)
    if bad := [s for s in stats if s not in STATS]:
        raise ValueError(f"unknown statistics {bad}; known are {STATS}")
    out: dict[str, Column] = {}
    for n in many(windows):
        w = trailing(df, check_window(n))
        plain = {"mean": F.avg(column), "std": F.stddev_samp(column), "min": F.min(column), "max": F.max(column), "skew": F.skewness(column)}
        for s in stats:
            if s == "zscore":
                value = div(F.col(column) - full(plain["mean"], column, w, n), full(plain["std"], column, w, n))
            else:
                value = full(plain[s], column, w, n)
            out[f"rolling_{s}_{n}"] = value
    return add(df, out)


def _with_returns(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("__ret", change(df, column))


def rolling_skewness(df: DataFrame, window: int = 63, column: str = "close") -> DataFrame:
    """Population skewness of returns, ``rolling_skew_{window}`` (the name that rolling_stats gives the skew of prices)."""
    check_window(window, 2)
    out = _with_returns(df, column)
    return add(out, {f"rolling_skew_{window}": full(F.skewness("__ret"), "__ret", trailing(out, window), window)}).drop("__ret")


def _row(df: DataFrame) -> Column:
    return F.row_number().over(series(df))


def _kurtosis(df: DataFrame, window: int) -> Column:
    w = trailing(df, window)
    value = moments_or_zero(F.kurtosis("__ret").over(w), F.var_pop("__ret").over(w))
    return F.when((_row(df) >= window) & (F.count("__ret").over(w) >= 4), value)


def rolling_kurtosis(df: DataFrame, window: int = 63, column: str = "close") -> DataFrame:
    """Population excess kurtosis of returns, ``rolling_kurtosis_{window}``: from row ``window`` on with four returns; 0 without variance."""
    check_window(window, 4)
    out = _with_returns(df, column)
    return add(out, {f"rolling_kurtosis_{window}": _kurtosis(out, window)}).drop("__ret")


def tail_ratio(df: DataFrame, window: int = 63, percentile: float = 0.05, column: str = "close") -> DataFrame:
    """``tail_ratio_{window}``: the upper quantile of returns over the lower one, absolute; needs ten returns."""
    check_window(window)
    if not 0 < percentile < 0.5:
        raise ValueError("percentile lies between 0 and 0.5")
    out = _with_returns(df, column)
    w = trailing(out, window)
    out = out.withColumn("__q", F.percentile("__ret", F.array(F.lit(percentile), F.lit(1 - percentile))).over(w))
    ratio = F.when(F.abs(F.col("__q")[0]) >= TINY, F.abs(div(F.col("__q")[1], F.col("__q")[0])))
    return add(out, {f"tail_ratio_{window}": F.when((_row(out) >= window) & (F.count("__ret").over(w) >= 10), ratio)}).drop("__ret", "__q")


def rolling_jarque_bera(df: DataFrame, window: int = 63, column: str = "close") -> DataFrame:
    """``rolling_jb_{window}`` = n / 6 (S² + K² / 4) of returns, from row ``window`` on with four returns."""
    check_window(window, 4)
    out = _with_returns(df, column)
    w = trailing(out, window)
    n, var = F.count("__ret").over(w), F.var_pop("__ret").over(w)
    s, k = moments_or_zero(F.skewness("__ret").over(w), var), moments_or_zero(F.kurtosis("__ret").over(w), var)
    return add(out, {f"rolling_jb_{window}": F.when((_row(out) >= window) & (n >= 4), n / 6.0 * (s * s + k * k / 4.0))}).drop("__ret")


def zscore_returns(df: DataFrame, window: int = 63, column: str = "close") -> DataFrame:
    """``zscore_returns_{window}``: the return against mean and sample deviation of the last ``window`` ones."""
    check_window(window, 2)
    out = _with_returns(df, column)
    w = trailing(out, window)
    z = div(F.col("__ret") - full(F.avg("__ret"), "__ret", w, window), full(F.stddev_samp("__ret"), "__ret", w, window))
    return add(out, {f"zscore_returns_{window}": z}).drop("__ret")
