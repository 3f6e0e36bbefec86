"""A corpus pipeline of five stages over documents; each is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import bpe, mixing, pii, quality, simhash
from lodestrand.llm.common import checkpoint, shared_folder, table
from lodestrand.llm.queries import good_ids, tokenizer


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, with bands around the texts that `labels` calls good.

    Null, empty and short texts go, as they fail the base rules; very long ones are read whole; repeated rows go or stay
    alike; an empty table gives none. All columns pass.
    """
    return quality.kept(docs, quality.fit(docs, good_ids(spark, sf_dir)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id.

    SimHash links are candidates, as are common bands of MinHashes; five-word shingles with a likeness of 0.8 decide. Texts
    without words are one group; different texts with one doc_id both stay; of rows that agree in doc_id and text one stays; a
    row without doc_id stays where all of its group are such. All columns pass.
    """
    return simhash.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind, and n_chars by the text's new length. Null texts stay null (n_chars null); repeated rows stay; all columns pass."""
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for. Texts without words are never taken; a null source is one of its own; rows that repeat each count; all columns pass."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text's bytes, for each row. A null text is an empty one; repeated rows stay."""
    ranks, pattern = tokenizer()
    out = bpe.round_trip(docs, ranks, pattern, ("doc_id", "lang", "source", "text"))
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL expresses neither zstandard nor SimHash nor BPE; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, checkpointed. The others are written below the shared folder, and each goes once the next is written."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"

    def written(docs: DataFrame, step: tuple[int, tuple]) -> DataFrame:
        k, (_, stage) = step
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        if k:
            _remove(spark, f"{root}/{k - 1}")
        return spark.read.parquet(f"{root}/{k}")

    docs = reduce(written, enumerate(STAGES[:-1]), docs)
    out = checkpoint(STAGES[-1][1](spark, docs, sf_dir))
    _remove(spark, root)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
