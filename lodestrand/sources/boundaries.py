"""External boundaries as JSON arrays and JSON lines, and byte sources in chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "struct<time_seconds: double, source: string, reference_offset: long>"


def parsed(text: Column) -> Column:
    """A record of one JSON object; null unless time_seconds is a number (not a boolean), source a string or missing (then `external`), and reference_offset an integer, null or missing."""
    v = F.try_parse_json(text)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    number = kind("$.time_seconds").rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|TINYINT|SMALLINT)")
    source_ok = F.coalesce(kind("$.source") == "STRING", F.lit(True))
    offset_ok = F.coalesce(kind("$.reference_offset").isin("BIGINT", "VOID"), F.lit(True))
    record = F.struct(
        F.try_variant_get(v, "$.time_seconds", "double").alias("time_seconds"),
        F.coalesce(F.try_variant_get(v, "$.source", "string"), F.lit("external")).alias("source"),
        F.try_variant_get(v, "$.reference_offset", "bigint").alias("reference_offset"),
    )
    return F.when(number & source_ok & offset_ok, record)


def from_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """lines with `record` (null: rejected); blank lines are skipped."""
    return lines.where(F.trim(text) != "").withColumn("record", parsed(F.col(text)))


def from_arrays(texts: DataFrame, text: str = "value") -> DataFrame:
    """One row an item of each JSON array, with its number from 1; texts that are no arrays give one row with number null and no record."""
    items = F.from_json(F.col(text), "array<string>")
    return texts.withColumn("items", items).selectExpr("*", "posexplode_outer(items) as (pos, item)").withColumn("n", F.col("pos") + 1).withColumn("record", parsed(F.col("item"))).drop("items", "pos")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Boundaries of a .json (one array) or .jsonl file, by its suffix; other suffixes are refused."""
    name = path.lower()
    if name.endswith(".jsonl"):
        rows = from_lines(spark.read.text(path))
    elif name.endswith(".json"):
        rows = from_arrays(spark.read.text(path, wholetext=True))
    else:
        raise ValueError("boundaries must be a .json or .jsonl file")
    return rows.where(F.expr("if(record is null, raise_error('invalid boundary'), true)")).select("record.*")


def chunks(spark: SparkSession, path: str, size: int = 65536) -> DataFrame:
    """stream_id (the path), seq, start_offset, data of each file, in pieces of size bytes."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    pieces = files.select(F.col("path").alias("stream_id"), "content", F.explode(F.expr(f"sequence(0L, length - 1, {size}L)")).alias("start_offset"))
    return pieces.select("stream_id", (F.col("start_offset") / size).cast("long").alias("seq"), "start_offset", F.expr(f"substring(content, cast(start_offset as int) + 1, {size})").alias("data"))
