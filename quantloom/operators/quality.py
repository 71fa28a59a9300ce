"""Checks of a bar table: gaps, outliers, splits, completeness."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import SYMBOL, TIMESTAMP, add, change, keys, require, whole, with_series_stats

PRICES = ("open", "high", "low", "close")
#: Entries of a list of gaps or jumps that comes to the driver; the DataFrames behind them are whole.
MOST = 100_000


def business_day_gaps(df: DataFrame, timestamp_col: str = TIMESTAMP) -> DataFrame:
    """symbol (if there is one) and each Monday to Friday between the first and the last day of a series that has no row."""
    on = keys(df)
    days = df.select(*on, F.to_date(timestamp_col).alias("day")).filter("day IS NOT NULL")
    span = days.groupBy(*on).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    wanted = span.select(*on, F.explode(F.sequence("a", "b")).alias("day")).filter(F.weekday("day") < 5)
    have = days.distinct()
    match = wanted["day"] == have["day"]
    for k in on:
        match = match & wanted[k].eqNullSafe(have[k])
    return wanted.join(have, match, "left_anti")


def detect_gaps(df: DataFrame, freq: str = "1bd", timestamp_col: str = TIMESTAMP) -> list[str] | dict[str, list[str]]:
    """Missing business days as text: a list, or lists by symbol if there are several symbols. The first ``MOST`` days; ``business_day_gaps`` has all as a DataFrame."""
    if freq != "1bd":
        raise ValueError("only freq='1bd' is known")
    require(df, timestamp_col)
    found = business_day_gaps(df, timestamp_col).orderBy("day", *keys(df)).limit(MOST).collect()
    if SYMBOL not in df.columns:
        return sorted(str(r["day"]) for r in found)
    symbols = [r[0] for r in df.select(SYMBOL).distinct().collect()]
    by: dict[str, list[str]] = {s: [] for s in symbols}
    for r in found:
        by[r[SYMBOL]].append(str(r["day"]))
    by = {s: sorted(d) for s, d in by.items()}
    return by if len(by) > 1 else next(iter(by.values()), [])


def flag_outliers(df: DataFrame, method: str = "zscore", threshold: float = 4.0, columns: Sequence[str] | None = None) -> DataFrame:
    """``{column}_outlier`` by deviations from the series' mean, or beyond its quartiles (nearest values) by a multiple of their distance; null is no outlier."""
    if method not in ("zscore", "iqr"):
        raise ValueError("method must be 'zscore' or 'iqr'")
    names = [c for c in PRICES if c in df.columns] if columns is None else list(columns)
    if not names:
        return df
    on = keys(df)
    if method == "zscore":
        stats = {f"__{f}_{c}": g(c) for c in names for f, g in (("mean", F.avg), ("dev", F.stddev_samp))}
        far = {f"{c}_outlier": F.coalesce(F.abs(F.col(c) - F.col(f"__mean_{c}")) > threshold * F.col(f"__dev_{c}"), F.lit(False)) for c in names}
        return add(with_series_stats(df, stats), far).drop(*stats)
    # Quartiles by rank over the exchange by symbol: sorted runs that spill, no list of values.
    out = df
    for c in names:
        order = Window.partitionBy(*(on or [F.lit(0)])).orderBy(F.col(c).asc_nulls_last())
        n = F.count(c).over(whole(out))
        at = lambda q: F.max(F.when(F.col("__rank") == F.round((F.col("__n") - 1) * q).cast("long") + 1, F.col(c))).over(whole(out))
        out = out.withColumns({"__rank": F.row_number().over(order), "__n": n})
        out = out.withColumns({"__q1": at(0.25), "__q3": at(0.75)})
        width = threshold * (F.col("__q3") - F.col("__q1"))
        far = (F.col(c) < F.col("__q1") - width) | (F.col(c) > F.col("__q3") + width)
        out = out.withColumn(f"{c}_outlier", F.coalesce(far, F.lit(False))).drop("__rank", "__n", "__q1", "__q3")
    return out


def detect_splits(df: DataFrame, threshold: float = 0.3, column: str = "close") -> DataFrame:
    """``suspected_split``: a move of more than ``threshold``."""
    require(df, column)
    return add(df, {"suspected_split": F.coalesce(F.abs(change(df, column)) > threshold, F.lit(False))})


def duplicate_rows(df: DataFrame) -> int:
    """Rows that have an equal; every copy counts."""
    copies = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    return int(copies.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0])


def completeness_frame(df: DataFrame) -> DataFrame:
    """One row of counts: rows, zero_volume_days, suspected_split_count, nulls_{column}, outliers_{column}."""
    checked = flag_outliers(detect_splits(df) if "close" in df.columns else df)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    aggs = [F.count(F.lit(1)).alias("rows"), (count(F.col("volume") == 0) if "volume" in df.columns else F.lit(0).cast("long")).alias("zero_volume_days")]
    aggs.append((count(F.col("suspected_split")) if "close" in df.columns else F.lit(0).cast("long")).alias("suspected_split_count"))
    aggs += [count(F.col(c).isNull()).alias(f"nulls_{c}") for c in df.columns]
    aggs += [count(F.col(f"{c}_outlier")).alias(f"outliers_{c}") for c in PRICES if c in df.columns]
    return checked.agg(*aggs)


def completeness_report(df: DataFrame) -> dict[str, Any]:
    """Counts, gaps and null shares of a bar table as one dictionary."""
    row = completeness_frame(df).first()
    gaps = detect_gaps(df) if TIMESTAMP in df.columns else []
    nulls = {c: int(row[f"nulls_{c}"]) for c in df.columns}
    return {
        "rows": int(row["rows"]), "columns": len(df.columns), "date_gaps": gaps, "date_gap_count": business_day_gaps(df).count() if TIMESTAMP in df.columns else 0,
        "duplicate_rows": duplicate_rows(df), "zero_volume_days": int(row["zero_volume_days"]), "null_counts": nulls, "null_pct": {c: 100.0 * n / row["rows"] if row["rows"] else 0.0 for c, n in nulls.items()},
        "outlier_counts": {f"{c}_outlier": int(row[f"outliers_{c}"]) for c in PRICES if c in df.columns}, "suspected_split_count": int(row["suspected_split_count"]),
    }
