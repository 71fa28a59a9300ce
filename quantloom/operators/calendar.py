"""Calendar features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import add, series


def calendar_features(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """ISO weekday (1-7), month, quarter, ISO week; flags for the first day of a month and the last row of a month or quarter (NULL on the last row)."""
    c, after = F.col(column), F.lead(column).over(series(df))
    return add(df, {
        "day_of_week": F.weekday(c) + 1, "month": F.month(c), "quarter": F.quarter(c), "week_of_year": F.weekofyear(c),
        "is_month_start": (F.dayofmonth(c) == 1).cast("byte"), "is_month_end": (F.month(c) != F.month(after)).cast("byte"), "is_quarter_end": (F.quarter(c) != F.quarter(after)).cast("byte"),
    })
