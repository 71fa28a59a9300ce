"""Helpers that every operator of this subpackage uses."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker works on at once, besides the Arrow batch that Spark sends.
BATCH_BYTES = 2 << 20
#: Rows of a batch. Texts are long, so the thousands of Spark's defaults would be tens of megabytes in each of several buffers.
BATCH_ROWS = 500


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in one process (tests), a temporary folder is set and used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    found = f"file://{tempfile.mkdtemp(prefix='quantloom-')}"
    spark.sparkContext.setCheckpointDir(found)
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quantloom/{name}-{uuid.uuid4().hex}"


def open_folder(uri: str):
    """A file system that executors reach, and the path in it; ``uri`` is inside the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if ":" in uri else f"file://{uri}")


#: Folders that results still read; they go when the driver's process ends. The JVM that can delete them is kept with each.
_LEFT: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for what only lives as long as this process."""
    path = fresh_path(spark, name)
    if not _LEFT:
        atexit.register(lambda: discard(*_LEFT))
    _LEFT[path] = spark
    return path


def discard(*paths: str | None) -> None:
    """Deletes scratch folders."""
    for path in list(paths):
        if path is not None and (spark := _LEFT.pop(path, None)) is not None:
            with contextlib.suppress(Exception):  # at the end of the process the JVM may be gone already
                hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """While it holds, the session's Arrow batches and batches of the Parquet and ORC readers have ``BATCH_ROWS`` rows at most; Spark reads these settings when a query runs."""
    before = {}
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.orc.columnarReaderBatchSize"):
        if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
            before[key] = spark.conf.get(key)
            spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def done_with(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    discard(*(getattr(t, "scratch", None) for t in tables))


def gathered(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of ``text_rows`` from several Arrow batches at once, as many as have ``most`` bytes of text at most (a longer text stands alone)."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for some, of in slices(batch.column(0).to_pylist(), batch.column(1).to_pylist(), most):
            size = sum(map(len, of))
            if ids and held + size > most:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids, texts, held = ids + some, texts + of, held + size
    if ids:
        yield ids, texts


def compact(df: DataFrame, name: str) -> DataFrame:
    """``written`` for rows of a few bytes each: dealt out evenly to as many files as the cluster has cores, not one for each split of the texts they come from. Every file costs the store a few calls, and on local stores a process."""
    return written(df.repartition(df.sparkSession.sparkContext.defaultParallelism), name)


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """Two columns, ``doc_id`` and the UTF-8 bytes of the text (a null text becomes empty), and the columns of ``also`` after them."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"), *also)


def slices(ids: list, texts: list[bytes], most: int = BATCH_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Cuts a batch where it has more than ``most`` bytes of text; a longer text stands alone."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield ids[start:i], texts[start:i]
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield ids[start:], texts[start:]


_KEPT: dict[object, object] = {}


def kept(key: object, make: Callable):
    """An object that a Python worker keeps from task to task. Objects of another operator go first: workers outlive stages, and their memory is shared out for one at a time."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Drops what other operators have kept in this worker."""
    if _KEPT:
        _KEPT.clear()
        trim()


def trim() -> None:
    """Gives free memory back to the system, as workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(rows: DataFrame, fn: Callable[[list, list[bytes]], Iterable | dict], schema: str, setup: Callable | None = None) -> DataFrame:
    """Runs ``fn(ids, texts, *state)`` over slices of ``text_rows``; it returns columns by name in the order of ``schema``.

    ``setup()`` is called once per task and its value is passed as the third argument. Columns of ``rows`` beyond the two
    (numbers all) come after those of ``schema``, unchanged.
    """
    names = [x.strip().split(" ")[0] for x in _fields(schema)]
    also = rows.columns[2:]
    full = schema + "".join(f", {c} long" for c in also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (setup(),) if setup else ()
        if not setup:
            release()
        for batch in batches:
            ids, texts, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            for some, of in slices(ids, texts):
                out = fn(some, of, *state)
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=_TYPES.get(k)) for x, k in zip((out[n] for n in names), _kinds(schema), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays + [batch.column(2 + k).slice(at, len(some)) for k in range(len(also))], names=names + also)
                at += len(some)
        trim()

    return rows.mapInArrow(run, full)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _fields(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _kinds(schema: str) -> list[str]:
    return [x.strip().split(" ", 1)[1] for x in _fields(schema)]
