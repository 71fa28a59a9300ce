"""Bar tables from raw event tables: open, high, low, close and volume per symbol and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_bars(df: DataFrame, symbol: Column | str, period: Column, price: Column | str, order: Column | str) -> DataFrame:
    """One row per symbol and period. ``order`` decides which price is first and last; volume counts rows. Partial aggregates shrink the data before the shuffle."""
    price, order = (F.col(x) if isinstance(x, str) else x for x in (price, order))
    return df.groupBy((F.col(symbol) if isinstance(symbol, str) else symbol).alias("symbol"), period.alias("timestamp")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )


def bars_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order totals by priority."""
    return build_bars(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority", F.to_date("o_orderdate"), "o_totalprice", "o_orderkey")


def bars_events(spark: SparkSession, sf_dir: str, daily: bool = False) -> DataFrame:
    """Hourly (or daily) bars of event values by type."""
    period = F.to_date("ts") if daily else F.date_trunc("hour", F.col("ts"))
    return build_bars(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", period, "value", "ts")


def with_benchmark(bars: DataFrame) -> DataFrame:
    """``benchmark_close``: the mean close of all symbols at the timestamp."""
    from pyspark.sql import Window

    return bars.withColumn("benchmark_close", F.avg("close").over(Window.partitionBy("timestamp")))
