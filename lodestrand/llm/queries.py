"""The queries opN_<name> of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, digest, mixing, pii, prefix_trees, quality, simhash, suffix_dedup, toxicity, urls
from .common import table

BASE_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_chunks", "n_outside")


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op2_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.chained(table(spark, sf_dir, "documents"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *tokenizer())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op10_prefix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trees.digests(table(spark, sf_dir, "documents"))


def good_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")


def good_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text of all documents that `labels` calls good."""
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(good_ids(spark, sf_dir), "doc_id", "left_semi")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.measure(docs, quality.fit(docs, good_ids(spark, sf_dir))).select(*BASE_COLUMNS)


def queries() -> dict:
    return {"op1_urls": op1_urls, "op2_digest": op2_digest, "op3_mix": op3_mix, "op4_bpe": op4_bpe, "op5_toxicity": op5_toxicity, "op6_suffix_dedup": op6_suffix_dedup, "op7_pii": op7_pii, "op8_quality": op8_quality, "op9_simhash": op9_simhash, "op10_prefix_trees": op10_prefix_trees}


def oracle_sql() -> dict[str, str]:
    return {"op3_mix": mixing.MIX_SQL.format(docs="documents"), "op6_suffix_dedup": suffix_dedup.DEDUP_SQL, "op10_prefix_trees": prefix_trees.DEDUP_SQL}
