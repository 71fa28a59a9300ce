"""Market regimes: volatility, trend, state, breakouts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import TINY
from ..functions.windows import add, change, check_window, div, full, series, trailing

#: Lags of the scaling law that the Hurst exponent is read from.
HURST_LAGS = (2, 4, 8, 16)
#: A trend is a move of more than this share over the window.
TREND = 0.02


def volatility_regime(df: DataFrame, fast_window: int = 21, slow_window: int = 63, column: str = "close") -> DataFrame:
    """``vol_ratio`` of the deviations of returns over two windows, and ``vol_regime`` (1 above one)."""
    check_window(fast_window, 2, "fast_window"), check_window(slow_window, 2, "slow_window")
    if fast_window >= slow_window:
        raise ValueError("fast_window must be smaller than slow_window")
    out = df.withColumn("__ret", change(df, column))
    dev = lambda n: full(F.stddev_samp("__ret"), "__ret", trailing(out, n), n)
    out = add(out, {"vol_ratio": div(dev(fast_window), dev(slow_window))})
    return add(out, {"vol_regime": (F.col("vol_ratio") > 1).cast("byte")}).drop("__ret")


def _hurst(df: DataFrame, window: int, column: str) -> tuple[DataFrame, Column]:
    """Slope of ln(deviation of x over lag L) on ln L, within the window, clamped to [0, 1]."""
    used = [k for k in HURST_LAGS if k < window // 2]
    w = series(df)
    df = df.withColumns({f"__d{k}": F.col(column) - F.lag(column, k).over(w) for k in used})
    logs = [math.log(k) for k in used]
    mean = sum(logs) / len(logs)
    spread = sum((x - mean) ** 2 for x in logs)
    tau = [F.stddev_pop(f"__d{k}").over(w.rowsBetween(-(window - 1 - k), 0)) for k in used]
    slope = sum((F.ln(F.when(t > TINY, t)) * ((x - mean) / spread) for t, x in zip(tau, logs)), F.lit(0.0))
    flat = F.least(*tau) <= TINY
    value = F.when(flat, 0.5).otherwise(F.greatest(F.least(slope, F.lit(1.0)), F.lit(0.0)))
    return df, F.when(F.count(column).over(trailing(df, window)) == window, value)


def trend_strength(df: DataFrame, window: int = 63, column: str = "close") -> DataFrame:
    """``hurst_{window}``, and ``trend_direction``: the sign of a move beyond two percent over the window (0 before it is full)."""
    check_window(window, 20)
    out, hurst = _hurst(df, window, column)
    moved = change(df, column, window)
    return add(out, {f"hurst_{window}": hurst, "trend_direction": F.when(moved > TREND, 1).when(moved < -TREND, -1).otherwise(0)}).drop(*[f"__d{k}" for k in HURST_LAGS])


def market_state(df: DataFrame, vol_window: int = 21, trend_window: int = 63, column: str = "close") -> DataFrame:
    """``market_state``: trending or ranging, with high or low volatility; an unknown regime counts as low and ranging."""
    out = trend_strength(volatility_regime(df, max(2, vol_window // 2), vol_window, column), trend_window, column)
    high, low, trend = F.col("vol_regime") == 1, F.col("vol_regime") == 0, F.col("trend_direction") != 0
    state = F.when(trend & high, "trending_high_vol").when(trend & low, "trending_low_vol").when(~trend & high, "ranging_high_vol").otherwise("ranging_low_vol")
    return add(out, {"market_state": state})


def breakout_detection(df: DataFrame, window: int = 20, n_std: float = 2.0, column: str = "close") -> DataFrame:
    """``breakout_strength_{window}`` in deviations from the mean, and ``breakout_{window}`` (1 outside the band; 0 while unknown)."""
    check_window(window, 2)
    w = trailing(df, window)
    mid, dev = full(F.avg(column), column, w, window), full(F.stddev_samp(column), column, w, window)
    c = F.col(column)
    outside = (c > mid + n_std * dev) | (c < mid - n_std * dev)
    return add(df, {f"breakout_strength_{window}": div(c - mid, dev), f"breakout_{window}": F.coalesce(outside, F.lit(False)).cast("byte")})
