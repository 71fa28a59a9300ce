"""Cross-sectional features: each row against the other symbols of its timestamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import SYMBOL, TIMESTAMP, add, div

METHODS = ("ordinal", "min", "max", "dense", "average")


def _rank(df: DataFrame, column: str, method: str) -> Column:
    day = Window.partitionBy(TIMESTAMP)
    ordered = day.orderBy(F.col(column).asc_nulls_last())
    equals = F.count(F.lit(1)).over(Window.partitionBy(TIMESTAMP, column))
    ranks = {
        "ordinal": lambda: F.row_number().over(day.orderBy(F.col(column).asc_nulls_last(), *([SYMBOL] if SYMBOL in df.columns else []))),
        "min": lambda: F.rank().over(ordered),
        "max": lambda: F.rank().over(ordered) + equals.cast("int") - 1,
        "dense": lambda: F.dense_rank().over(ordered),
        "average": lambda: F.rank().over(ordered) + (equals - 1) / 2.0,
    }
    if method not in ranks:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    return F.when(F.col(column).isNotNull(), ranks[method]())


def cross_rank(df: DataFrame, column: str = "close", method: str = "ordinal") -> DataFrame:
    """``{column}_rank`` within the timestamp; ties of ``ordinal`` go by symbol, nulls have no rank."""
    return add(df, {f"{column}_rank": _rank(df, column, method)})


def cross_percentile(df: DataFrame, column: str = "close") -> DataFrame:
    """``{column}_percentile``: average rank over the values of the timestamp."""
    return add(df, {f"{column}_percentile": div(_rank(df, column, "average"), F.count(column).over(Window.partitionBy(TIMESTAMP)))})


def cross_zscore(df: DataFrame, column: str = "close") -> DataFrame:
    """``{column}_zscore`` by mean and sample deviation of the timestamp."""
    w = Window.partitionBy(TIMESTAMP)
    return add(df, {f"{column}_zscore": div(F.col(column) - F.avg(column).over(w), F.stddev_samp(column).over(w))})
