"""Lagged columns, and the proof that a feature doesn't look ahead."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import SYMBOL, TIMESTAMP, add, many, series


def lags(df: DataFrame, columns: str | Sequence[str] = "close", lags: int | Sequence[int] = 1) -> DataFrame:
    """``{column}_lag_{k}``; lags are positive, as others would look ahead."""
    steps = many(lags)
    if bad := [k for k in steps if k <= 0]:
        raise ValueError(f"lags must be positive, not {bad}")
    names = [columns] if isinstance(columns, str) else list(columns)
    return add(df, {f"{c}_lag_{k}": F.lag(c, k).over(series(df)) for c in names for k in steps})


def validate_no_lookahead(df_full: DataFrame, df_partial: DataFrame, feature_columns: Sequence[str], tolerance: float = 1e-10) -> bool:
    """Whether features computed on a part of the rows equal those computed on all. Columns that either lacks are skipped."""
    on = [k for k in (TIMESTAMP, SYMBOL) if k in df_full.columns and k in df_partial.columns]
    checked = [c for c in feature_columns if c in df_full.columns and c in df_partial.columns]
    if not checked:
        return True
    part = df_partial.select(*on, *[F.col(c).alias(f"__p_{c}") for c in checked])
    differs = F.lit(False)
    for c in checked:
        differs = differs | F.coalesce(F.abs(F.col(c) - F.col(f"__p_{c}")) > tolerance, F.lit(False))
    return df_full.select(*on, *checked).join(part, on).filter(differs).isEmpty()
