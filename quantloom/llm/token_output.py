"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt out by ranges of their id and sorted within each, so files ascend with ids and every stripe and row group
holds a narrow range of them. ORC's writer encodes ids by run lengths, keeps statistics for each row group and a Bloom filter
of document ids, so readers take stripes in parallel and skip those that can't hold a document.

Defined results: a null or empty text is one end id; document ids are keys, and where one repeats its rows stand side by side
in the order of their texts; a null id sorts first; an empty table gives an empty file set; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import compact, gathered, small_batches, text_rows
from .piece_encoder import loaded

#: Columns of the file format. ``part`` is the range that the file belongs to, ``at`` the ids of earlier documents in it.
FORMAT = "doc_id long, part int, at long, n_tokens long, ids array<int>"


#: Bytes of text that are encoded at once: the more, the seldomer a part is looked up anew.
SLICE_BYTES = 5 << 20


def range_bounds(ids: DataFrame) -> list[int]:
    """First ids of all ranges but the first, for as many ranges as there are shuffle partitions: quantiles of the id column alone, so no text is read to find them."""
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n) if n > 1 else []
    return sorted({int(x) for x in found})


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds up to ``key`` (0 for null): by groups of bounds first, then within one group."""
    step = max(1, int(len(bounds) ** 0.5))
    array = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    upto = lambda xs: F.size(F.filter(xs, lambda b: b <= key))
    if not bounds:
        return F.lit(0)
    group = upto(array(bounds[step::step]))
    return F.coalesce(group * step + upto(F.slice(array(bounds), group * step + 1, F.lit(step))), F.lit(0)).cast("int")


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", rows_per_index: int = 1000) -> None:
    """Encodes every text, appends ``end_id`` and writes the format to ``path``. Only texts are shuffled, once, by range of id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, at = loaded(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for ids, texts in gathered(batches, SLICE_BYTES):
            data = [x + end for x in encoder.encode(texts)]
            n = np.fromiter(map(len, data), np.int64, len(data)) // 4
            ends = np.cumsum(n)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.frombuffer(b"".join(data), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.full(len(ids), part, np.int32)), pa.array(at + ends - n), pa.array(n), tokens], names=["doc_id", "part", "at", "n_tokens", "ids"])
            at += int(ends[-1])

    rows, bounds = text_rows(df, id_col, text_col), range_bounds(df.select(F.col(id_col).cast("long").alias("doc_id")))
    encoded = rows.repartitionById(len(bounds) + 1, range_of(F.col("doc_id"), bounds)).sortWithinPartitions("doc_id", "text").mapInArrow(run, FORMAT)
    writer = encoded.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", str(rows_per_index))
    with small_batches(df.sparkSession):
        writer.option("orc.create.index", "true").option("compression", "lz4").orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows; with ``doc_ids``, only those, found by statistics and Bloom filters of stripes and row groups."""
    rows = spark.read.schema(FORMAT).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(list(doc_ids)))


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """For each file range, the ids in all ranges before it: one row per range, from the narrow columns alone."""
    sums = read_tokens(spark, path).groupBy("part").agg(F.max(F.col("at") + F.col("n_tokens")).alias("n")).collect()
    before, out = 0, []
    for x in sorted(sums):
        out.append((x["part"], before))
        before += x["n"]
    return spark.createDataFrame(out, "part int, before long")


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 over little-endian 32-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            values, cuts = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[s:e].tobytes()) for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("at"), pa.array(np.diff(cuts).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    found = compact(read_tokens(spark, path).mapInArrow(run, "doc_id long, part int, at long, n_tokens long, ids_crc32 long"), "token-summaries")
    return found.join(F.broadcast(offsets(spark, path)), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
