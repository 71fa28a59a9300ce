"""Token counts from flat, unindexed token files by a separator scan.

A flat file is nothing but ids of a fixed width; documents end with an end-of-document id. The files are cut into blocks of
equal size that tasks read by byte range. Within a block, one vectorised comparison finds the separators. Documents that
cross blocks are stitched by a prefix scan over one small row per block: documents so far, and the last separator so far.

Defined results: ids after the last separator of a file are one unfinished document (``closed`` false); an empty file has
none; a separator right after another is a document of one token (the separator counts); a null or empty text is written as
a separator alone; repeated ids are rows of their own; texts of any length are written whole; an empty table gives no documents;
columns besides id and text are ignored, whatever their names. The literal of the end-of-document token in a text is encoded as
ordinary characters; should the end id come from inside a text all the same, as with an end id that is no special token of
the vocabulary, writing fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gathered, open_folder, text_rows
from .piece_encoder import loaded

#: Bytes of a block, a multiple of every width.
BLOCK_BYTES = 4 << 20
#: Bytes of text that are encoded at once.
SLICE_BYTES = 4 << 20


def write_token_files(df: DataFrame, path: str, tokenizer: str, end_id: int, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes one flat file per partition and returns the manifest: file, position of the document in it, doc_id.

    A task writes under a name of its own attempt and the manifest names only files of attempts whose rows arrived, so a lost
    executor or a second attempt leaves at most a file that nothing refers to.
    """
    if width not in (2, 4):
        raise ValueError("width is 2 or 4 bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        encoder, name, at = loaded(tokenizer, plain=True), f"{task.partitionId():06d}-{task.taskAttemptId()}.bin", 0
        system, top = open_folder(path)
        system.create_dir(top, recursive=True)
        end = np.array([end_id], "<u4").tobytes()
        with system.open_output_stream(f"{top}/{name}") as out:
            for ids, texts in gathered(batches, SLICE_BYTES):
                data = np.frombuffer(b"".join(x + end for x in encoder.encode(texts)), "<u4")
                if width == 2 and len(data) and data.max() > 0xFFFF:
                    raise ValueError("an id needs more than two bytes")
                if np.count_nonzero(data == end_id) != len(ids):
                    raise ValueError("a text holds the end id")
                out.write(data.astype(f"<u{width}").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array(range(at, at + len(ids)), pa.int64()), pa.array(ids, pa.int64())], names=["file", "position", "doc_id"])
                at += len(ids)

    return text_rows(df, id_col, text_col).mapInArrow(run, "file string, position long, doc_id long")


def blocks(spark: SparkSession, path: str, files: DataFrame | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each block of the flat files in ``path`` (only of those in ``files``, if given): file, block, first byte, bytes.

    Sizes come from the file system's listing; the number of rows is that of blocks, not of tokens.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(s.getPath().getName(), s.getLen()) for s in (system.listStatus(hadoop) if system.exists(hadoop) else []) if s.isFile() and s.getPath().getName().endswith(".bin")]
    listed = spark.createDataFrame(found, "file string, size long")
    if files is not None:
        listed = listed.join(files.select("file").distinct(), "file", "left_semi")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block_bytes).cast("long")))
    return listed.filter("size > 0").select("file", "size", at.alias("block")).select("file", "block", (F.col("block") * block_bytes).alias("start"), F.least(F.lit(block_bytes).cast("long"), F.col("size") - F.col("block") * block_bytes).alias("n_bytes"))


def scan_blocks(pieces: DataFrame, path: str, end_id: int, width: int = 2) -> DataFrame:
    """Per block: first token, tokens, and the ends of documents (tokens from the block's start to just after a separator)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_folder(path)
        for batch in batches:
            for x in batch.to_pylist():
                with system.open_input_file(f"{top}/{x['file']}") as f:
                    ids = np.frombuffer(f.read_at(x["n_bytes"], x["start"]), f"<u{width}")
                ends = np.flatnonzero(ids == end_id) + 1
                yield pa.RecordBatch.from_arrays([pa.array([x["file"]]), pa.array([x["block"]], pa.int64()), pa.array([x["start"] // width], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], names=["file", "block", "first", "n", "ends"])

    parts = max(pieces.sparkSession.sparkContext.defaultParallelism * 3, 1)
    return pieces.repartition(parts).mapInArrow(run, "file string, block long, first long, n long, ends array<long>")


def count_documents(scanned: DataFrame) -> DataFrame:
    """Stitches scanned blocks: one row per document with file, position, start (token), n_tokens and closed."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("ends") > 0, F.col("first") + F.element_at("ends", -1))
    carried = scanned.select("file", "block", last.alias("last"), F.size("ends").alias("k"), (F.col("first") + F.col("n")).alias("stop")).select(
        "file", "block", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("docs"), F.coalesce(F.max("last").over(before), F.lit(0)).alias("from"), "last", "stop", "k"
    )
    done = (
        scanned.filter(F.size("ends") > 0).join(carried.select("file", "block", "docs", "from"), ["file", "block"])
        .select("file", "docs", "from", F.transform("ends", lambda e: e + F.col("first")).alias("ends"))
        .select("file", "docs", F.posexplode(F.arrays_zip(F.concat(F.array("from"), F.slice("ends", 1, F.size("ends") - 1)).alias("start"), F.col("ends").alias("stop"))))
        .select("file", (F.col("docs") + F.col("pos")).alias("position"), F.col("col.start").alias("start"), (F.col("col.stop") - F.col("col.start")).alias("n_tokens"), F.lit(True).alias("closed"))
    )
    ends = carried.groupBy("file").agg(F.sum("k").alias("position"), F.coalesce(F.max("last"), F.lit(0)).alias("start"), F.max("stop").alias("stop"))
    rest = ends.filter("stop > start").select("file", "position", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return done.unionByName(rest)
