"""Tickers through a fetcher that the user provides; the library itself opens no connection."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import cast_ohlcv_types, standardize_columns

_KEPT = ("timestamp", "open", "high", "low", "close", "volume", "symbol")


def _market(symbol: str, start: str | None, end: str | None, interval: str) -> pd.DataFrame:
    """The default fetcher: a public market-data client, if it is installed."""
    try:
        import yfinance
    except ImportError as e:
        raise ImportError("no fetcher is set and no market-data client is installed; call set_fetcher(f)") from e
    return yfinance.Ticker(symbol).history(start=start, end=end, interval=interval, auto_adjust=True).reset_index()


_fetcher: list[Callable] = [_market]


def set_fetcher(fetcher: Callable | None) -> None:
    """``fetcher(symbol, start, end, interval)`` returns a pandas table with a date and prices; None restores the default."""
    _fetcher[0] = fetcher or _market


def fetch_ticker(spark: SparkSession, symbol: str, start: str | None = None, end: str | None = None, interval: str = "1d") -> DataFrame:
    """The bars of one ticker in standard form; daily timestamps are dates. ValueError if there are none."""
    found = _fetcher[0](symbol, start, end, interval)
    if found is None or not len(found):
        raise ValueError(f"no data for {symbol}")
    df = cast_ohlcv_types(standardize_columns(spark.createDataFrame(found))).withColumn("symbol", F.lit(symbol.upper()))
    if interval == "1d":
        df = df.withColumn("timestamp", F.to_date("timestamp"))
    return df.select(*[c for c in _KEPT if c in df.columns])
