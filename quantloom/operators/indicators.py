"""Technical indicators. Each takes a bar table and returns it with columns appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import add, check_window, div, ewm, full, series, trailing, upto


def _lag(df: DataFrame, c: str, k: int = 1):
    return F.lag(c, k).over(series(df))


def sma(df: DataFrame, period: int = 20, column: str = "close") -> DataFrame:
    """Simple moving average ``sma_{period}``."""
    check_window(period, name="period")
    return add(df, {f"sma_{period}": full(F.avg(column), column, trailing(df, period), period)})


def ema(df: DataFrame, period: int = 20, column: str = "close") -> DataFrame:
    """Exponential moving average ``ema_{period}`` of span ``period``."""
    return ewm(df, {f"ema_{period}": (column, period)})


def rsi(df: DataFrame, period: int = 14, column: str = "close") -> DataFrame:
    """Relative strength ``rsi_{period}`` from span-based means of gains and losses; 100 without losses, NULL if nothing moves."""
    step = F.col(column) - _lag(df, column)
    out = ewm(df.withColumn("__step", step), {"__gain": (F.greatest(F.col("__step"), F.lit(0.0)) + F.col("__step") * 0, period), "__loss": (F.greatest(-F.col("__step"), F.lit(0.0)) + F.col("__step") * 0, period)}, [("__gain", "__loss")])
    g, l = F.col("__gain"), F.col("__loss")  # noqa: E741
    value = F.when((l == 0) & (g > 0), 100.0).otherwise(100 - div(100.0, 1 + div(g, l)))
    return add(out, {f"rsi_{period}": value}).drop("__step", "__gain", "__loss")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, column: str = "close") -> DataFrame:
    """``macd_line``, ``macd_signal`` and ``macd_hist``; names don't carry the parameters."""
    out = ewm(df, {"__fast": (column, fast), "__slow": (column, slow)}, [("__fast", "__slow")])
    out = ewm(add(out, {"macd_line": F.col("__fast") - F.col("__slow")}), {"macd_signal": ("macd_line", signal)})
    return add(out, {"macd_hist": F.col("macd_line") - F.col("macd_signal")}).drop("__fast", "__slow")


def bollinger(df: DataFrame, period: int = 20, std: float = 2.0, column: str = "close") -> DataFrame:
    """``bb_middle``, ``bb_upper``, ``bb_lower``: mean and ``std`` sample deviations around it."""
    check_window(period, 2, "period")
    w = trailing(df, period)
    mid, dev = full(F.avg(column), column, w, period), full(F.stddev_samp(column), column, w, period)
    return add(df, {"bb_middle": mid, "bb_upper": mid + std * dev, "bb_lower": mid - std * dev})


def _true_range(df: DataFrame):
    prev = _lag(df, "close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def atr(df: DataFrame, period: int = 14) -> DataFrame:
    """Average true range ``atr_{period}``, a span-based mean."""
    return ewm(df.withColumn("__tr", _true_range(df)), {f"atr_{period}": ("__tr", period)}).drop("__tr")


def _typical():
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def vwap(df: DataFrame) -> DataFrame:
    """Volume-weighted average price since the series began."""
    w = upto(df)
    return add(df, {"vwap": div(F.sum(_typical() * F.col("volume")).over(w), F.sum("volume").over(w))})


def obv(df: DataFrame) -> DataFrame:
    """On-balance volume; the first row is 0."""
    out = df.withColumn("__signed", F.coalesce(F.signum(F.col("close") - _lag(df, "close")) * F.col("volume"), F.lit(0.0)))
    return add(out, {"obv": F.sum("__signed").over(upto(df))}).drop("__signed")


def stochastic(df: DataFrame, k_period: int = 14, d_period: int = 3) -> DataFrame:
    """``stoch_k`` and its moving average ``stoch_d``."""
    check_window(k_period, name="k_period"), check_window(d_period, name="d_period")
    w = trailing(df, k_period)
    low, high = full(F.min("low"), "low", w, k_period), full(F.max("high"), "high", w, k_period)
    out = add(df, {"stoch_k": div(F.col("close") - low, high - low) * 100})
    return add(out, {"stoch_d": full(F.avg("stoch_k"), "stoch_k", trailing(df, d_period), d_period)})


def adx(df: DataFrame, period: int = 14) -> DataFrame:
    """``plus_di``, ``minus_di`` and ``adx_{period}``. Where both directions are nil there is no direction, and the mean begins after that."""
    up, down = F.col("high") - _lag(df, "high"), _lag(df, "low") - F.col("low")
    zero = F.lit(0.0)
    moves = df.withColumns({"__plus": F.when(up > down, F.greatest(up, zero)).otherwise(zero), "__minus": F.when(down > up, F.greatest(down, zero)).otherwise(zero), "__tr": _true_range(df)})
    means = ewm(moves, {"__p": ("__plus", period), "__m": ("__minus", period), "__t": ("__tr", period)}, [("__p", "__m")])  # neither move is ever null
    both = add(means, {"plus_di": div(F.col("__p"), F.col("__t")) * 100, "minus_di": div(F.col("__m"), F.col("__t")) * 100})
    dx = div(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")) * 100
    return ewm(both.withColumn("__dx", dx), {f"adx_{period}": ("__dx", period)}).drop("__plus", "__minus", "__tr", "__p", "__m", "__t", "__dx")


def cci(df: DataFrame, period: int = 20) -> DataFrame:
    """Commodity channel index ``cci_{period}`` by the sample deviation of the typical price."""
    check_window(period, 2, "period")
    out, w = df.withColumn("__tp", _typical()), trailing(df, period)
    mid, dev = full(F.avg("__tp"), "__tp", w, period), full(F.stddev_samp("__tp"), "__tp", w, period)
    return add(out, {f"cci_{period}": div(F.col("__tp") - mid, 0.015 * dev)}).drop("__tp")


def williams_r(df: DataFrame, period: int = 14) -> DataFrame:
    check_window(period, name="period")
    w = trailing(df, period)
    low, high = full(F.min("low"), "low", w, period), full(F.max("high"), "high", w, period)
    return add(df, {f"williams_r_{period}": div(high - F.col("close"), high - low) * -100})


def mfi(df: DataFrame, period: int = 14) -> DataFrame:
    """Money flow index ``mfi_{period}``; 100 without negative flow."""
    check_window(period, name="period")
    out = df.withColumn("__tp", _typical())
    out = out.withColumns({"__step": F.col("__tp") - _lag(out, "__tp"), "__flow": F.col("__tp") * F.col("volume")})
    flow, step, zero, w = F.col("__flow"), F.col("__step"), F.lit(0.0), trailing(df, period)
    out = out.withColumns({"__pos": F.when(step > 0, flow).otherwise(zero), "__neg": F.when(step < 0, flow).otherwise(zero)})
    pos, neg = full(F.sum("__pos"), "__pos", w, period), full(F.sum("__neg"), "__neg", w, period)
    value = F.when(neg == 0, 100.0).otherwise(100 - div(100.0, 1 + div(pos, neg)))
    return add(out, {f"mfi_{period}": F.when(neg.isNotNull(), value)}).drop("__tp", "__step", "__flow", "__pos", "__neg")


def roc(df: DataFrame, period: int = 10, column: str = "close") -> DataFrame:
    """Rate of change in percent, ``roc_{period}``."""
    check_window(period, name="period")
    return add(df, {f"roc_{period}": div(F.col(column) - _lag(df, column, period), _lag(df, column, period)) * 100})


def momentum(df: DataFrame, period: int = 10, column: str = "close") -> DataFrame:
    check_window(period, name="period")
    return add(df, {f"momentum_{period}": F.col(column) - _lag(df, column, period)})
