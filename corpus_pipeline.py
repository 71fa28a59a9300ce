"""A corpus pipeline of five operators: two quality filters, near-duplicates, benchmark decontamination and tokens.

Each stage gets what the one before kept, as a table, and gives back rows with the columns of ``documents``; the last gives
one row of token digests per document. Nothing here can be said in SQL (fitted models, hashes, edit distances), so there is
no SQL twin; the stages are tested against brute force.

A stage that leaves rows out finds them where texts are read and lists them by file and place; texts aren't shuffled. Defined
results: null and empty texts fail the quality rules; rows that repeat id and text count as copies; rows with a null id go
through like any other; an empty table gives an empty result; extra columns of ``documents`` are kept up to the last stage,
whatever their names. What a stage has written is deleted once the next one has been.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import bpe_stream, decontaminate, quality_classifier, quality_rules, shingle_dedup
from quantloom.llm.common import compact, documents, done_with, written
from quantloom.llm.queries import vocabulary


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects go."""
    return quality_classifier.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or whose posterior quality is low go."""
    return quality_rules.keep(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays: that of the smallest id."""
    return shingle_dedup.drop_similar(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within the error budget go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return compact(bpe_stream.digests(docs, vocabulary("word_bpe_49k.json")), "token-digests")


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("simhash_dedup", dedup),
    ("decontamination", decontaminate_stage),
    ("bpe", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        done_with(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    done_with(docs)
    return out
