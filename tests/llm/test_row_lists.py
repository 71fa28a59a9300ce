import pytest
from pyspark.sql import functions as F

from quantloom.llm import row_lists as rl
from quantloom.llm.common import BATCH_ROWS, _LEFT, done_with, scratch_path, written

from .conftest import SF


@pytest.mark.parametrize("block", [1 << 20, 16])
def test_lists_leave_out_and_pick_rows(spark, monkeypatch, block):
    """A plain scan, a filtered table and rows that are no table; lists of some rows, of all and of none."""
    monkeypatch.setattr(rl, "BLOCK", block)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (docs, docs.filter("doc_id % 7 <> 2"), spark.createDataFrame([(i, "t") for i in range(50)] * 2, "doc_id long, text string")):
        table = rl.numbered(rl.stored(df))
        n = df.count()
        for rule in ("doc_id % 3 = 0", "doc_id >= 0", "doc_id < 0"):
            path = rl.save(table.filter(rule).select(rl.FILE, rl.ROW))
            rest = rl.without(table, path)
            assert rest.columns == df.columns
            want = sorted(r.doc_id for r in df.filter(f"NOT ({rule})").collect())
            assert sorted(r.doc_id for r in rest.collect()) == want
            assert table.filter(rl.listed(path)).count() == n - len(want)


def test_places_are_unique_and_stable(spark):
    table = rl.numbered(spark.read.parquet(f"{SF}/documents.parquet"))
    first = table.select("doc_id", rl.FILE, rl.ROW).collect()
    assert len({r[1:] for r in first}) == len(first) and sorted(first) == sorted(table.repartition(3).select("doc_id", rl.FILE, rl.ROW).collect())


def test_settings_and_folders_are_given_back(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.orc.columnarReaderBatchSize")
    before = [spark.conf.get(k) for k in keys]
    t = written(spark.range(10), "ten")
    assert [spark.conf.get(k) for k in keys] == before and BATCH_ROWS < int(before[0])
    path = t.scratch
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    assert system.exists(hadoop) and path in _LEFT and t.agg(F.sum("id")).first()[0] == 45
    done_with(t)
    assert not system.exists(hadoop) and path not in _LEFT
    assert scratch_path(spark, "x") in _LEFT
