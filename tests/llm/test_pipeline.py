from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from quantloom.llm import bpe_stream, decontaminate, quality_classifier, quality_rules, queries
from quantloom.llm.common import documents, written

from .conftest import SF
from .test_shingle_dedup import want_of


def test_stages_decide_as_their_operators_do(spark):
    """Every stage over what the one before kept, against the operator's own per-row verdicts."""
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "quality_rules", "simhash_dedup", "decontamination", "bpe"] and cp.ORACLE_SQL is None
    docs = documents(spark, SF)
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: Counter(r[0] for r in df.select("doc_id").collect())
    verdicts = [
        lambda d: ids(quality_classifier.score(d, labels).filter("predicted = 1")),
        lambda d: ids(quality_rules.judge(d).filter("kept")),
        lambda d: Counter(want_of([tuple(r) for r in d.select("doc_id", "text").collect()])),  # all pairs: five words, 0.8
        lambda d: ids(d) - Counter({r.doc_id: 1 for r in decontaminate.find_leaks(d, bench).collect()}),
    ]
    sizes = [docs.count()]
    for (name, stage), verdict in zip(cp.STAGES, verdicts):
        want = verdict(docs)
        out = written(stage(spark, docs, SF), name)
        assert out.columns == documents(spark, SF).columns and ids(out) == want, name
        docs = out
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] > sizes[4] > 0
    last = sorted(map(tuple, bpe_stream.digests(docs, queries.vocabulary("word_bpe_49k.json")).collect()))
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == last


def test_stages_bear_hard_rows(spark, docs, empty):
    """All stages over hard rows with the columns of documents, and over no rows."""
    for df in (docs, empty):
        d = df.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"))
        for name, stage in cp.STAGES:
            before = d.columns
            d = written(stage(spark, d, SF), name)
            assert name == "bpe" or d.columns == before


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)} and "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_small_queries(spark):
    for name in ("op2_token_counts", "op3_sharding"):
        out = queries.QUERIES[name](spark, SF)
        assert out.count() == documents(spark, SF).count() and out.filter(F.col("doc_id").isNull()).count() == 0
