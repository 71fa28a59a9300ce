"""One query for each operator of this subpackage, with the parameters of production, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_stream, chat_format, decontaminate, license_scan, quality_classifier, quality_rules, sharding, simhash_dedup, token_counts, token_output
from .common import compact, documents, scratch_path, written

#: The end-of-document id of each use of the byte-level vocabulary.
OUTPUT_END_ID, FLAT_END_ID = 2, 50256
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def vocabulary(name: str) -> str:
    """Where the vocabulary file of a public tokenizer lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are written as flat 16-bit token files; their counts come from the files alone."""
    path = scratch_path(spark, "flat-tokens")
    manifest = written(token_counts.write_token_files(documents(spark, sf_dir), path, vocabulary("byte_bpe_50k.json"), FLAT_END_ID), "manifest")
    scanned = written(token_counts.scan_blocks(token_counts.blocks(spark, path, manifest), path, FLAT_END_ID), "scan")
    counted = token_counts.count_documents(scanned)
    return counted.join(manifest, ["file", "position"], "left").select("doc_id", "n_tokens", "closed")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir).select("doc_id", "source", "n_chars"), "doc_id", SHARDS)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-output")
    token_output.write_tokens(documents(spark, sf_dir), path, vocabulary("byte_bpe_50k.json"), OUTPUT_END_ID)
    return token_output.summaries(spark, path)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(bpe_stream.digests(documents(spark, sf_dir), vocabulary("word_bpe_49k.json")), "token-digests")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    given = given.unionByName(spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string"))
    return chat_format.digests(chat_format.format_conversations(given))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_token_counts": op2_token_counts,
    "op3_sharding": op3_sharding,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_output": op6_token_output,
    "op7_bpe": op7_bpe,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_chat_format": op10_chat_format,
}
ORACLES: dict[str, str] = {"op10_chat_format": chat_format.ORACLE_SQL}
