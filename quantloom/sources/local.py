"""Files as bar tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schema import cast_ohlcv_types, detect_ohlcv_schema, standardize_columns

#: Suffix -> how Spark reads it. A JSON file is one document with an array of rows.
READERS = {
    "csv": lambda r, p: r.option("header", True).option("inferSchema", True).csv(p),
    "parquet": lambda r, p: r.parquet(p),
    "pq": lambda r, p: r.parquet(p),
    "json": lambda r, p: r.option("multiLine", True).json(p),
}


def suffix(path: str) -> str:
    name = str(path).rstrip("/").replace("\\", "/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def exists(spark: SparkSession, path: str) -> bool:
    """In any store that Spark reads; patterns count if something matches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def load_local(spark: SparkSession, path: str) -> DataFrame:
    """Reads CSV, Parquet or JSON lazily, renames columns and, for bar tables, casts them."""
    path = str(path)
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if (kind := suffix(path)) not in READERS:
        raise ValueError(f"unsupported file type .{kind}; known are {', '.join(sorted(READERS))}")
    df = standardize_columns(READERS[kind](spark.read, path))
    return cast_ohlcv_types(df) if detect_ohlcv_schema(df) else df
