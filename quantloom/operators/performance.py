"""Performance against a benchmark. Pairs of returns count, so rows where either is missing don't."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import TINY
from ..functions.windows import TRADING_DAYS, add, change, check_window, keys, require, series, trailing


def _pairs(df: DataFrame, benchmark_col: str, column: str) -> DataFrame:
    require(df, column, benchmark_col)
    out = df.withColumns({"__a": change(df, column), "__b": change(df, benchmark_col)})
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return out.withColumns({"__a": F.when(both, F.col("__a")), "__b": F.when(both, F.col("__b"))})


def alpha_beta(df: DataFrame, benchmark_col: str = "benchmark_close", column: str = "close", window: int | None = None) -> DataFrame:
    """Slope of returns on benchmark returns and annual intercept. Per symbol: zeros with fewer than two pairs. Rolling: ``alpha_{window}``, ``beta_{window}``."""
    out = _pairs(df, benchmark_col, column)
    over = trailing(out, check_window(window, 2)) if window is not None else None
    at = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    n, var = at(F.count("__a")), at(F.var_samp("__b"))
    beta = F.when(F.coalesce(var < TINY, F.lit(True)), 0.0).otherwise(at(F.covar_samp("__a", "__b")) / F.nullif(var, F.lit(0.0)))
    alpha = (at(F.avg("__a")) - beta * at(F.avg("__b"))) * TRADING_DAYS
    if window is None:
        return out.groupBy(*keys(df)).agg(F.when(n < 2, 0.0).otherwise(alpha).alias("alpha"), F.when(n < 2, 0.0).otherwise(beta).alias("beta"))
    ready = (F.row_number().over(series(out)) > window) & (n >= 4)
    return add(out, {f"alpha_{window}": F.when(ready, alpha), f"beta_{window}": F.when(ready, beta)}).drop("__a", "__b")


def information_ratio(df: DataFrame, benchmark_col: str = "benchmark_close", column: str = "close") -> DataFrame:
    """Annual mean active return over its population deviation, per symbol; 0 without deviation."""
    out = _pairs(df, benchmark_col, column).withColumn("__x", F.col("__a") - F.col("__b"))
    dev = F.stddev_pop("__x")
    return out.groupBy(*keys(df)).agg(F.when(dev >= TINY, F.avg("__x") / dev * math.sqrt(TRADING_DAYS)).otherwise(0.0).alias("information_ratio"))
