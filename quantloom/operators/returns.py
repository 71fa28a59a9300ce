"""Returns and drawdowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import add, change, check_window, div, many, positive_log, series, upto


def returns(df: DataFrame, periods: int | Sequence[int] = 1, column: str = "close") -> DataFrame:
    """Simple returns ``returns_{p}d``."""
    return add(df, {f"returns_{check_window(p, name='periods')}d": change(df, column, p) for p in many(periods)})


def log_returns(df: DataFrame, periods: int | Sequence[int] = 1, column: str = "close") -> DataFrame:
    """Logarithmic returns ``log_returns_{p}d``; NULL where a price isn't positive."""
    w = series(df)
    return add(df, {f"log_returns_{check_window(p, name='periods')}d": positive_log(div(F.col(column), F.lag(column, p).over(w))) for p in many(periods)})


def cumulative_returns(df: DataFrame, column: str = "close") -> DataFrame:
    return add(df, {"cumulative_returns": div(F.col(column), F.first(column).over(upto(df))) - 1})


def drawdown(df: DataFrame, column: str = "close") -> DataFrame:
    """``drawdown`` from the running maximum, and its running minimum ``max_drawdown``."""
    w = upto(df)
    top = F.max(column).over(w)
    out = add(df, {"drawdown": div(F.col(column) - top, top)})
    return add(out, {"max_drawdown": F.min("drawdown").over(w)})
