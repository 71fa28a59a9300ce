"""Prices that were fetched before, as Parquet partitioned by symbol and interval.

Each entry also says which range of dates it covers, so a request counts as a hit only if it lies within. An entry is replaced
by writing the new one aside first, so a failed write loses nothing.
"""

from __future__ import annotations

import logging
import tempfile
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import config

log = logging.getLogger(__name__)
_COLUMNS = ("timestamp", "open", "high", "low", "close", "volume")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _entry(symbol: str, interval: str) -> str:
    return f"{config.cache_dir}/interval={interval}/symbol={symbol.upper()}"


def _writable(spark: SparkSession) -> None:
    """Where the cache's folder can't be made and Spark runs in one process, a temporary folder takes its place; on a cluster that would be a different one on each machine."""
    try:
        system, top = _fs(spark, config.cache_dir)
        made = system.mkdirs(top)
    except Exception as e:
        log.warning("%s can't be made: %s", config.cache_dir, e)
        made = False
    if not made and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-"):
        config.cache_dir = f"{tempfile.gettempdir()}/quantloom-cache"
        log.warning("prices are kept in %s", config.cache_dir)


def cache_get(spark: SparkSession, symbol: str, start: str | None = None, end: str | None = None, interval: str = "1d") -> DataFrame | None:
    """Rows of the symbol in the range, ends included; None if they aren't all there or anything fails."""
    try:
        system, path = _fs(spark, _entry(symbol, interval))
        if not system.exists(path):
            return None
        rows = spark.read.parquet(_entry(symbol, interval))
        covered = rows.select("covers_from", "covers_to").first()
        if covered is None:
            return None
        a, b = covered
        if (a is not None and (start is None or str(start) < a)) or (b is not None and str(end or date.today()) > b):
            return None
        if start:
            rows = rows.filter(F.col("timestamp") >= F.lit(str(start)).cast("timestamp"))
        if end:
            rows = rows.filter(F.col("timestamp") < F.lit(str(end)).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
        rows = rows.drop("covers_from", "covers_to").withColumn("symbol", F.lit(symbol.upper()))
        return None if rows.isEmpty() else rows
    except Exception as e:  # a cache that can't be read is no cache
        log.warning("cache of %s can't be read: %s", symbol, e)
        return None


def cache_put(spark: SparkSession, symbol: str, df: DataFrame, start: str | None = None, end: str | None = None, interval: str = "1d") -> None:
    """Replaces the entry; failures are logged and leave the old one."""
    try:
        _writable(spark)
        entry, aside = _entry(symbol, interval), f"{_entry(symbol, interval)}.new"
        rows = df.select(*[c for c in _COLUMNS if c in df.columns])
        rows = rows.withColumns({"covers_from": F.lit(str(start) if start else None).cast("string"), "covers_to": F.lit(str(end or date.today())).cast("string")})
        rows.write.mode("overwrite").parquet(aside)
        system, old = _fs(spark, entry)
        system.delete(old, True)
        system.rename(_fs(spark, aside)[1], old)
    except Exception as e:
        log.warning("cache of %s can't be written: %s", symbol, e)


def cache_clear(spark: SparkSession, symbol: str | None = None) -> None:
    """Drops all entries, or those of one symbol."""
    system, top = _fs(spark, config.cache_dir)
    if not system.exists(top):
        return
    if symbol is None:
        system.delete(top, True)
        return
    for interval in system.listStatus(top):
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(interval.getPath(), f"symbol={symbol.upper()}"), True)
