"""Structured Streaming: events become bars by a watermarked window; features are computed on the bars that are stored."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_bars(events: DataFrame, symbol: str = "event_type", price: str = "value", time: str = "ts", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars per symbol and window of event time. State is dropped, and the bar emitted, once the watermark passes its end; later events are ignored."""
    bars = events.withWatermark(time, late).groupBy(F.col(symbol).alias("symbol"), F.window(time, every).alias("w")).agg(
        F.min_by(price, time).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, time).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    return bars.select("symbol", F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "volume")


def feature_batches(bars: DataFrame, path: str, checkpoint: str, features: Callable[[DataFrame], DataFrame], keep_rows: Callable[[DataFrame], DataFrame] | None = None, out: str | None = None, history_days: int | None = None):
    """Starts a query that stores closed bars under ``path`` and writes the features of all stored bars of the symbols at hand to ``out``.

    Row windows can't run on streams, so features are a batch job per micro-batch. A batch is stored under its number: one that
    is repeated after a failure replaces itself; it is computed once and read back. Bars are stored by day: with
    ``history_days`` a batch reads no day further than that before its own first one, so its cost doesn't grow with the age of
    the stream. Without it all stored bars of the symbols are read; ``keep_rows`` limits them further.
    """
    if history_days is not None and history_days < 0:
        raise ValueError("history_days is a number of days")

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df.withColumn("day", F.to_date("timestamp")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={number}")
        schema = T.StructType([*df.schema.fields, T.StructField("batch", T.LongType()), T.StructField("day", T.DateType())])
        stored = spark.read.schema(schema).parquet(path)
        fresh = stored.filter(F.col("batch") == number)
        history = stored.filter(F.col("batch") <= number)
        if history_days is not None and (first := fresh.agg(F.min("day")).first()[0]) is not None:
            history = history.filter(F.col("day") >= F.lit(first - timedelta(days=history_days)))
        history = history.join(fresh.select("symbol").distinct(), "symbol", "left_semi").drop("batch", "day")
        history = keep_rows(history) if keep_rows else history
        made = features(history).join(fresh.select("symbol", "timestamp"), ["symbol", "timestamp"], "left_semi")
        made.write.mode("overwrite").parquet(f"{out or path + '-features'}/batch={number}")

    return bars.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch)
