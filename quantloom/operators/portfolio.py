"""Portfolio analytics over the symbols of a bar table.

Matrices come from pairs of symbols joined on their timestamps, never from a collected table; only symbol lists and k x k
covariances reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import SYMBOL, TIMESTAMP, TRADING_DAYS, add, change, check_window, div, require, series, trailing
from ..plans.chunked import by_chunks


def symbols_of(df: DataFrame) -> list[str]:
    require(df, SYMBOL)
    return sorted(r[0] for r in df.select(SYMBOL).distinct().collect() if r[0] is not None)


def _needed(df: DataFrame, column: str, least: int = 2) -> list[str]:
    require(df, SYMBOL, TIMESTAMP, column)
    found = symbols_of(df)
    if len(found) < least:
        raise ValueError(f"{least} symbols at least are needed, there are {len(found)}")
    return found


def _complete(df: DataFrame, column: str, n: int) -> DataFrame:
    """Returns at timestamps where every symbol has one."""
    rets = df.select(TIMESTAMP, SYMBOL, change(df, column).alias("ret")).filter("ret IS NOT NULL AND symbol IS NOT NULL")
    return rets.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(TIMESTAMP))).filter(F.col("__n") == n).drop("__n")


def _pairs(rets: DataFrame, value: str = "ret") -> DataFrame:
    """Moments of each pair of symbols, from one self-join on the timestamp that makes each pair once."""
    a, b = rets.select(TIMESTAMP, F.col(SYMBOL).alias("sym_a"), F.col(value).alias("x")), rets.select(TIMESTAMP, F.col(SYMBOL).alias("sym_b"), F.col(value).alias("y"))
    half = a.join(b, TIMESTAMP).filter("sym_a <= sym_b").groupBy("sym_a", "sym_b").agg(F.covar_samp("x", "y").alias("cov"), F.var_samp("x").alias("var_x"), F.var_samp("y").alias("var_y"))
    both = F.struct("sym_a", "sym_b", "cov", "var_x", "var_y")
    turned = F.struct(F.col("sym_b").alias("sym_a"), F.col("sym_a").alias("sym_b"), "cov", F.col("var_y").alias("var_x"), F.col("var_x").alias("var_y"))
    return half.select(F.explode(F.when(F.col("sym_a") == F.col("sym_b"), F.array(both)).otherwise(F.array(both, turned))).alias("p")).select("p.*")


def _matrix(pairs: DataFrame, value: str, symbols: list[str]) -> DataFrame:
    spark = pairs.sparkSession
    frame = pairs.groupBy(F.col("sym_a").alias(SYMBOL)).pivot("sym_b", symbols).agg(F.first(value))
    return spark.createDataFrame([(s,) for s in symbols], f"{SYMBOL} string").join(frame, SYMBOL, "left").orderBy(SYMBOL)


def correlation_pairs(df: DataFrame, column: str = "close", method: str = "pearson") -> DataFrame:
    """sym_a, sym_b, corr over complete timestamps; NULL for constant returns."""
    if method not in ("pearson", "spearman"):
        raise ValueError("method must be 'pearson' or 'spearman'")
    rets = _complete(df, column, len(_needed(df, column)))
    if method == "spearman":
        w = Window.partitionBy(SYMBOL)
        tied = F.count(F.lit(1)).over(Window.partitionBy(SYMBOL, "ret"))
        rets = rets.withColumn("ret", F.rank().over(w.orderBy("ret")) + (tied - 1) / 2.0)
    return _pairs(rets).select("sym_a", "sym_b", div(F.col("cov"), F.sqrt(F.col("var_x") * F.col("var_y"))).alias("corr"))


def correlation_matrix(df: DataFrame, column: str = "close", method: str = "pearson") -> DataFrame:
    """``symbol`` and a column per symbol."""
    return _matrix(correlation_pairs(df, column, method), "corr", _needed(df, column))


def covariance_pairs(df: DataFrame, column: str = "close", annualize: bool = True) -> DataFrame:
    return _pairs(_complete(df, column, len(_needed(df, column)))).select("sym_a", "sym_b", (F.col("cov") * (TRADING_DAYS if annualize else 1)).alias("cov"))


def covariance_matrix(df: DataFrame, column: str = "close", annualize: bool = True) -> DataFrame:
    """``symbol`` and a column per symbol; sample covariances of returns, times 252 if annual."""
    return _matrix(covariance_pairs(df, column, annualize), "cov", _needed(df, column))


def rolling_correlation(df: DataFrame, symbol_a: str, symbol_b: str, window: int = 63, column: str = "close") -> DataFrame:
    """timestamp and ``rolling_corr_{A}_{B}_{window}`` over all timestamps of either symbol: pairs in the frame, two at least, from row ``window`` on."""
    check_window(window, 2)
    a, b = symbol_a.upper(), symbol_b.upper()
    if a == b:
        raise ValueError("two different symbols are needed")
    require(df, SYMBOL, TIMESTAMP, column)
    rets = df.select(TIMESTAMP, F.upper(SYMBOL).alias("__s"), change(df, column).alias("ret"))
    both = rets.groupBy(TIMESTAMP).agg(F.max(F.when(F.col("__s") == a, F.col("ret"))).alias("x"), F.max(F.when(F.col("__s") == b, F.col("ret"))).alias("y"))
    found = {r[0] for r in df.select(F.upper(SYMBOL)).filter(F.upper(SYMBOL).isin(a, b)).distinct().collect()}
    if missing := {a, b} - found:
        raise ValueError(f"no such symbols: {sorted(missing)}")
    pair = F.col("x").isNotNull() & F.col("y").isNotNull()
    both = both.withColumns({"x": F.when(pair, F.col("x")), "y": F.when(pair, F.col("y"))})
    name = f"rolling_corr_{a}_{b}_{window}"

    def correlated(part: DataFrame) -> DataFrame:
        w = trailing(part, window)
        corr = div(F.covar_samp("x", "y").over(w), F.sqrt(F.var_samp("x").over(w) * F.var_samp("y").over(w)))
        ready = (F.row_number().over(series(part)) >= window) & (F.count("x").over(w) >= 2)
        return add(part, {name: F.when(ready, corr)})

    # The pair is one series of all timestamps: chunks of it run side by side.
    return by_chunks(both.filter(F.col(TIMESTAMP).isNotNull()), correlated, window - 1).select(TIMESTAMP, name)


def portfolio_returns(df: DataFrame, weights: dict[str, float], column: str = "close") -> DataFrame:
    """timestamp and ``portfolio_returns``: weights are scaled to one, a missing return counts 0 (so the first one is 0)."""
    require(df, SYMBOL, TIMESTAMP, column)
    if not weights:
        raise ValueError("weights are empty")
    total = float(sum(weights.values()))
    if abs(total) < 1e-15:
        raise ValueError("weights sum to zero")
    found = set(symbols_of(df))
    if missing := sorted(set(weights) - found):
        raise ValueError(f"no such symbols: {missing}")
    scaled = df.sparkSession.createDataFrame([(s, w / total) for s, w in weights.items()], f"{SYMBOL} string, __w double")  # a row per weight given
    rets = df.select(TIMESTAMP, SYMBOL, change(df, column).alias("ret"))
    return rets.join(F.broadcast(scaled), SYMBOL).groupBy(TIMESTAMP).agg(F.sum(F.coalesce("ret", F.lit(0.0)) * F.col("__w")).alias("portfolio_returns"))


def equal_weight_returns(df: DataFrame, column: str = "close") -> DataFrame:
    return portfolio_returns(df, dict.fromkeys(symbols_of(df), 1.0), column)


def minimum_variance_weights(df: DataFrame, column: str = "close") -> dict[str, float]:
    """Weights of least variance (they may be negative): the pseudo-inverse of the covariance matrix applied to ones, scaled to one."""
    symbols = _needed(df, column)
    found = {(r["sym_a"], r["sym_b"]): r["cov"] for r in covariance_pairs(df, column).collect()}
    cov = np.array([[found.get((a, b)) for b in symbols] for a in symbols], float)
    if not np.isfinite(cov).all():
        raise ValueError("too few timestamps with all symbols for a covariance matrix")
    raw = np.linalg.pinv(cov) @ np.ones(len(symbols))
    if abs(raw.sum()) < 1e-15:
        raise ValueError("the covariance matrix gives no weights")
    return dict(zip(symbols, (raw / raw.sum()).tolist()))
