"""The usual set of features in one call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..sources.schema import OHLCV
from .calendar import calendar_features
from .indicators import atr, bollinger, macd, obv, rsi, sma, stochastic, vwap
from .lags import lags
from .returns import returns
from .rolling import rolling_stats


def add_all(df: DataFrame, indicators: bool = True, returns_: bool = True, lags_: Sequence[int] | None = None, rolling_windows: Sequence[int] | None = None, calendar: bool = False) -> DataFrame:
    """Indicators (those of volume and range only for a full bar table), returns of 1, 5 and 21 rows, and on request lags, rolling statistics, calendar. One exchange by symbol serves them all."""
    if indicators:
        df = sma(bollinger(macd(rsi(df))), 50)
        if set(OHLCV) <= set(df.columns):
            df = stochastic(obv(vwap(atr(df))))
    if returns_:
        df = returns(df, [1, 5, 21])
    if lags_:
        df = lags(df, "close", list(lags_))
    if rolling_windows:
        df = rolling_stats(df, list(rolling_windows))
    return calendar_features(df) if calendar else df
