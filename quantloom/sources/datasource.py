"""Tickers as a Spark data source: one partition per symbol, so executors fetch in parallel.

    register(spark, fetcher)
    spark.read.format("tickers").option("symbols", "AAA,BBB").option("start", "2024-01-01").load()

``fetcher(symbol, start, end, interval)`` returns a pandas table and runs on executors, so it must be picklable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .schema import standard_name

SCHEMA = "timestamp timestamp, open double, high double, low double, close double, volume double, symbol string"
_NUMBERS = ("open", "high", "low", "close", "volume")


def _rows(found: pd.DataFrame | None, symbol: str) -> Iterator[tuple]:
    """Rows of the fixed schema; columns that are missing are null, and so are values that aren't numbers."""
    if found is None or not len(found):
        return
    table = found.rename(columns={c: standard_name(c) for c in found.columns})
    table = table.loc[:, ~table.columns.duplicated()]
    times = pd.to_datetime(table["timestamp"]).dt.tz_localize(None)
    values = [pd.to_numeric(table[c], errors="coerce") if c in table.columns else pd.Series([None] * len(table)) for c in _NUMBERS]
    for t, *xs in zip(times, *values):
        yield (t.to_pydatetime() if t is not pd.NaT else None, *(None if pd.isna(x) else float(x) for x in xs), symbol.upper())


def register(spark: SparkSession, fetcher: Callable) -> None:
    """Makes the format ``tickers`` known to the session."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.options = options

        def partitions(self) -> list[InputPartition]:
            symbols = [s.strip() for s in self.options.get("symbols", "").split(",") if s.strip()]
            if not symbols:
                raise ValueError("option 'symbols' is empty")
            return [InputPartition(s) for s in symbols]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from _rows(fetcher(partition.value, self.options.get("start"), self.options.get("end"), self.options.get("interval", "1d")), partition.value)

    class Tickers(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tickers"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader(dict(self.options))

    spark.dataSource.register(Tickers)
