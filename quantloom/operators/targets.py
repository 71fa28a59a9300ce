"""Labels for supervised learning. All of them look ahead on purpose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import add, change, check_window, div, full, many, series, trailing


def _ahead(df: DataFrame, column: str, period: int) -> Column:
    return div(F.lead(column, check_window(period, name="period")).over(series(df)), F.col(column)) - 1


def forward_returns(df: DataFrame, periods: int | Sequence[int] = 1, column: str = "close") -> DataFrame:
    """``fwd_return_{p}d``: the return of the next ``p`` rows, NULL where they aren't there."""
    return add(df, {f"fwd_return_{p}d": _ahead(df, column, p) for p in many(periods)})


def classify_returns(df: DataFrame, period: int = 5, thresholds: Sequence[float] = (-0.01, 0.01), column: str = "close") -> DataFrame:
    """``label_{period}d``: -1, 0 or 1; rows without a future are 0."""
    low, high = thresholds
    out = df.withColumn("__fwd", _ahead(df, column, period))
    return add(out, {f"label_{period}d": F.when(F.col("__fwd") > high, 1).when(F.col("__fwd") < low, -1).otherwise(0)}).drop("__fwd")


def triple_barrier_labels(df: DataFrame, profit_take: float = 0.02, stop_loss: float = 0.02, max_holding: int = 10, column: str = "close") -> DataFrame:
    """``tb_label``, ``tb_duration``, ``tb_return``: which barrier the next ``max_holding`` prices touch first.

    The prices ahead are one bounded frame per row; the first to pass a barrier is found by a filter over it. Without one, the
    last row of the frame decides by the sign of its return (0 if its price is missing). Rows without a positive price are NULL.
    """
    check_window(max_holding, name="max_holding")
    w = series(df)
    out = df.withColumn("__row", F.row_number().over(w))
    price = F.col(column)
    ahead = F.collect_list(F.struct(F.col("__row").alias("row"), price.alias("price"))).over(w.rowsBetween(1, max_holding))
    out = out.withColumn("__ahead", ahead)
    up, down = price * (1 + profit_take), price * (1 - stop_loss)
    first = F.try_element_at(F.filter("__ahead", lambda x: (x["price"] >= up) | (x["price"] <= down)), F.lit(1))
    out = out.withColumns({"__hit": first, "__end": F.try_element_at("__ahead", F.lit(-1))})
    hit, end = F.col("__hit"), F.col("__end")
    last = F.coalesce(end["price"], F.when(end.isNull(), price)) / F.nullif(price, F.lit(0.0)) - 1
    label = F.when(hit.isNotNull(), F.when(hit["price"] >= up, 1).otherwise(-1)).otherwise(F.coalesce(F.signum(last), F.lit(0.0)).cast("int"))
    took = F.coalesce(hit["row"], end["row"], F.col("__row")) - F.col("__row")
    ret = F.when(hit.isNotNull(), hit["price"] / F.nullif(price, F.lit(0.0)) - 1).otherwise(F.coalesce(last, F.lit(0.0)))
    usable = price > 0
    return add(out, {"tb_label": F.when(usable, label), "tb_duration": F.when(usable, took), "tb_return": F.when(usable, ret)}).drop("__row", "__ahead", "__hit", "__end")


def volatility_adjusted_labels(df: DataFrame, period: int = 5, vol_window: int = 21, vol_multiplier: float = 1.0, column: str = "close") -> DataFrame:
    """``vol_label_{period}d``: the forward return against a multiple of the deviation of returns; 0 while either is unknown."""
    check_window(vol_window, 2, "vol_window")
    out = df.withColumns({"__ret": change(df, column), "__fwd": _ahead(df, column, period)})
    band = vol_multiplier * full(F.stddev_samp("__ret"), "__ret", trailing(out, vol_window), vol_window)
    return add(out, {f"vol_label_{period}d": F.when(F.col("__fwd") > band, 1).when(F.col("__fwd") < -band, -1).otherwise(0)}).drop("__ret", "__fwd")
