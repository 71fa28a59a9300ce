"""Loading bar tables: files, tickers through a fetcher, and the cache between."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import config
from .cache import cache_clear, cache_get, cache_put
from .local import READERS, load_local, suffix
from .remote import fetch_ticker, set_fetcher

__all__ = ["load", "load_local", "cache_clear", "cache_get", "cache_put", "fetch_ticker", "set_fetcher", "is_file_path"]


#: Tickers that are fetched at the same time.
FETCHES = 8


def is_file_path(source: str) -> bool:
    """A path has a slash or the suffix of a file that can be read; a dot alone doesn't make one."""
    return "/" in source or "\\" in source or suffix(source) in READERS


def load(spark: SparkSession, source: str | Path | Sequence[str], start: str | None = None, end: str | None = None, interval: str = "1d", backend: str | None = None, use_cache: bool = True):
    """A bar table from a file, a ticker or several tickers. The range holds for files too, where it is pushed to the scan."""
    if backend not in (None, "spark", "pandas"):
        raise ValueError("backend is 'spark' or 'pandas'")
    if isinstance(source, (list, tuple)):
        df = _tickers(spark, list(source), start, end, interval, use_cache)
    elif isinstance(source, Path) or is_file_path(source):
        df = _between(load_local(spark, str(source)), start, end)
    else:
        df = _ticker(spark, source, start, end, interval, use_cache)
    return df.toPandas() if (backend or config.default_backend) == "pandas" else df


def _between(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if "timestamp" not in df.columns:
        return df
    if start:
        df = df.filter(F.col("timestamp") >= F.lit(str(start)).cast(df.schema["timestamp"].dataType))
    if end:
        last = F.lit(str(end)).cast(df.schema["timestamp"].dataType)
        day_after = F.lit(str(end)).cast("timestamp") + F.expr("INTERVAL 1 DAY")
        df = df.filter(F.col("timestamp") < day_after if df.schema["timestamp"].dataType.typeName() == "timestamp" and len(str(end)) <= 10 else F.col("timestamp") <= last)
    return df


def _ticker(spark: SparkSession, symbol: str, start, end, interval: str, use_cache: bool, fetch: Callable = fetch_ticker) -> DataFrame:
    cached = use_cache and config.cache_enabled
    if cached and (found := cache_get(spark, symbol, start, end, interval)) is not None:
        return found
    df = fetch(spark, symbol, start, end, interval)
    if cached:
        cache_put(spark, symbol, df, start, end, interval)
    return df


def _tickers(spark: SparkSession, symbols: list[str], start, end, interval: str, use_cache: bool) -> DataFrame:
    """Symbols that can't be had are left out; if none can, that is an error. Several are fetched at a time; rows are in no order."""

    def one(symbol: str) -> DataFrame | ValueError:
        try:
            return _ticker(spark, symbol, start, end, interval, use_cache)
        except ValueError as e:
            return e

    with ThreadPoolExecutor(min(FETCHES, max(len(symbols), 1))) as pool:
        found = list(pool.map(one, symbols))
    parts = [x for x in found if isinstance(x, DataFrame)]
    if not parts:
        raise ValueError("no data for any symbol: " + "; ".join(f"{s}: {e}" for s, e in zip(symbols, found)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
