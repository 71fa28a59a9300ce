"""Lists of rows of a stored table, so that rows can be left out or picked without a shuffle of their texts.

A row of a Parquet table is known by its file and its place in it. A list of rows is one small bitmap in the shared folder for
each ``BLOCK`` rows of a file; a task that reads a file opens the bitmaps of the rows at hand and no others. So nothing is
broadcast, nothing grows on the driver, and the text of a row moves from the scan to the output only.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import done_with, open_folder, scratch_path, written

#: Rows of a bitmap.
BLOCK = 1 << 20
#: The columns that know a row.
FILE, ROW = "__quantloom_file", "__quantloom_row"
#: Bitmaps that a worker holds.
HELD = 16


def _is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is a plain read of Parquet files, whose rows have a file and a place."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def stored(df: DataFrame) -> DataFrame:
    """``df`` itself if it is a plain read of Parquet files, else a copy in the shared folder."""
    return df if _is_scan(df) else written(df, "rows")


def numbered(table: DataFrame) -> DataFrame:
    """A ``stored`` table with two more columns: a hash (64 bits) of the file's path, and the row's number in the file."""
    found = table.metadataColumn("_metadata")
    return table.select("*", F.xxhash64(found["file_path"]).alias(FILE), found["row_index"].alias(ROW))


_BITMAPS: dict[tuple[str, int, int], np.ndarray | None] = {}


def _name(file: int, block: int) -> str:
    return f"{file & (1 << 64) - 1:016x}-{block}.bits"


def save(rows: DataFrame) -> str:
    """Stores the rows (``FILE``, ``ROW``) as a list and returns its folder. Attempts of a task write equal bitmaps, so it doesn't matter whose stays."""
    spark = rows.sparkSession
    path = scratch_path(spark, "row-list")

    def put(part: pd.DataFrame) -> pd.DataFrame:
        from pyspark import TaskContext

        file, block = int(part["file"].iloc[0]), int(part["block"].iloc[0])
        bits = np.zeros(BLOCK, bool)
        bits[part["bit"].to_numpy()] = True
        system, top = open_folder(path)
        system.create_dir(top, recursive=True)
        name = f"{top}/{_name(file, block)}"
        mine = f"{name}.{TaskContext.get().taskAttemptId()}"
        with system.open_output_stream(mine) as out:
            out.write(zlib.compress(np.packbits(bits).tobytes(), 1))
        system.move(mine, name)
        return pd.DataFrame({"n": [int(bits.sum())]})

    placed = rows.select(F.col(FILE).alias("file"), F.floor(F.col(ROW) / BLOCK).cast("long").alias("block"), F.pmod(F.col(ROW), F.lit(BLOCK)).cast("int").alias("bit"))
    done_with(written(placed.groupBy("file", "block").applyInPandas(put, "n long"), "row-list-sizes"))
    return path


def _bitmap(path: str, file: int, block: int) -> np.ndarray | None:
    key = path, file, block
    if key not in _BITMAPS:
        while len(_BITMAPS) >= HELD:
            del _BITMAPS[next(iter(_BITMAPS))]
        system, top = open_folder(path)
        name = f"{top}/{_name(file, block)}"
        if system.get_file_info(name).is_file:
            with system.open_input_stream(name) as f:
                _BITMAPS[key] = np.unpackbits(np.frombuffer(zlib.decompress(f.read()), np.uint8)).astype(bool)
        else:
            _BITMAPS[key] = None
    return _BITMAPS[key]


def holds(path: str, files: np.ndarray, rows: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """Whether the list at ``path``, whose bitmaps have ``size`` rows, has each of the rows."""
    out, block = np.zeros(len(rows), bool), rows // size
    for f in np.unique(files):
        for b in np.unique(block[files == f]):
            bits = _bitmap(path, int(f), int(b))
            if bits is not None:
                here = (files == f) & (block == b)
                out[here] = bits[rows[here] % size]
    return out


def listed(path: str) -> Column:
    """``holds`` for rows of ``numbered``. Only the two numbers of a row go to Python."""
    size = BLOCK

    @F.pandas_udf("boolean")
    def inside(file: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series(holds(path, file.to_numpy(np.int64), row.to_numpy(np.int64), size))

    return inside(F.col(FILE), F.col(ROW))


def without(rows: DataFrame, path: str) -> DataFrame:
    """The rows of a ``numbered`` table that the list doesn't have, without the two columns."""
    return rows.filter(~listed(path)).drop(FILE, ROW)
