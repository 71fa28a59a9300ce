"""Column names and types of bar tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

OHLCV = ("timestamp", "open", "high", "low", "close", "volume")
REQUIRED = ("timestamp", "close")

#: Names that files use, and the standard ones.
ALIASES = {
    "date": "timestamp",
    "datetime": "timestamp",
    "time": "timestamp",
    "Date": "timestamp",
    "Datetime": "timestamp",
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Close": "close",
    "Adj Close": "close",
    "adj_close": "close",
    "Volume": "volume",
    "vol": "volume",
    "Vol": "volume",
    "Symbol": "symbol",
    "ticker": "symbol",
    "Ticker": "symbol",
}


def standard_name(name: str) -> str:
    """The alias, or lower case with underscores for a name that has capitals."""
    return ALIASES.get(name) or (name.lower().replace(" ", "_") if name != name.lower() else name)


def standardize_columns(df: DataFrame) -> DataFrame:
    """Renames to the standard names. Where two columns claim one name, a plain one wins over an adjusted one, which becomes ``adj_close``; others keep theirs with a number."""
    taken: dict[str, str] = {}
    for c in sorted(df.columns, key=lambda c: (c != standard_name(c), "adj" in c.lower(), df.columns.index(c))):
        want = standard_name(c)
        if want in taken.values():
            want = "adj_close" if "adj" in c.lower() else want
            k = 2
            while want in taken.values():
                want, k = f"{standard_name(c)}_{k}", k + 1
        taken[c] = want
    return df.select(*[F.col(f"`{c}`").alias(taken[c]) for c in df.columns])


def validate_ohlcv(df: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}; there are {df.columns}")
    return df


def detect_ohlcv_schema(df: DataFrame) -> bool:
    """Whether the table would be a bar table after renaming."""
    return set(REQUIRED) <= {standard_name(c) for c in df.columns}


def cast_ohlcv_types(df: DataFrame) -> DataFrame:
    """Prices and volume as doubles (what isn't a number, NaN included, becomes NULL); text timestamps as dates if all parse so, else as they are times."""
    out = {}
    for c in ("open", "high", "low", "close", "volume"):
        if c in df.columns:
            x = F.col(c).try_cast("double")
            out[c] = F.when(~F.isnan(x), x)
    if "timestamp" in df.columns and isinstance(df.schema["timestamp"].dataType, T.StringType):
        out["timestamp"] = _parsed(df)
    return df.withColumns(out)


def _parsed(df: DataFrame):
    """One type for the whole column, decided by one pass over it."""
    ts = F.col("timestamp")
    seen = df.agg(
        F.count(ts).alias("n"),
        F.count(F.when(ts.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}\s*$"), ts.try_cast("date"))).alias("dates"),
        F.count(ts.try_cast("timestamp")).alias("times"),
    ).first()
    if seen["n"] and seen["dates"] == seen["n"]:
        return ts.try_cast("date")
    return ts.try_cast("timestamp") if seen["n"] and seen["times"] else ts
