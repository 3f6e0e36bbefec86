"""Streams bound to the tables of TESTDATA.md: any table with a key, an order and a number can stand for a signal.

Each function takes (spark, sf_dir) and gives the table model that the operators work on. Streams are keyed by
stream_id, so that a whole corpus of streams resolves in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEVEL_SECONDS = 0.5
PCM_RATE = 10


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, idx, start_s, end_s, rms: half-second envelope levels."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    idx = F.row_number().over(order).cast("long") - 1
    out = read(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), idx.alias("idx"), F.col("value").alias("rms"))
    return out.select("stream_id", "idx", (F.col("idx") * LEVEL_SECONDS).alias("start_s"), (F.col("idx") * LEVEL_SECONDS + LEVEL_SECONDS).alias("end_s"), "rms")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, idx, time_s, offset, length, samples, sample_rate: half-second encoded frames."""
    before = Window.partitionBy("stream_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    out = levels(spark, sf_dir).withColumn("length", F.floor("rms").cast("long") + 1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))
    return out.select("stream_id", "idx", F.col("start_s").alias("time_s"), offset.alias("offset"), "length", F.lit(22050).alias("samples"), F.lit(44100).alias("sample_rate"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, seq, title, t: metadata events in seconds since the epoch."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.row_number().over(order).cast("long").alias("seq"), F.col("event_type").alias("title"), seconds.alias("t"))


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, i, sample: signed 16-bit samples at PCM_RATE."""
    sample = (F.bround(F.col("rms") * 100).cast("int") % 32768) - 16384
    return levels(spark, sf_dir).select("stream_id", F.col("idx").alias("i"), sample.alias("sample"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, idx, vec: vectors in the order of each label."""
    idx = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long") - 1
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("stream_id"), idx.alias("idx"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, seq, start_offset, end_offset, is_gap: byte ranges from running sums; a returned line leaves a gap before it."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("stream_id"), F.row_number().over(order).cast("long").alias("seq"), F.col("l_quantity").cast("long").alias("size"), (F.col("l_returnflag") == "R").cast("long").alias("gap")
    )
    run = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("size") + 10 * F.col("gap")).over(run)
    return rows.select("stream_id", "seq", (end - F.col("size")).alias("start_offset"), end.alias("end_offset"), (F.col("gap") == 1).alias("is_gap"))


#: The same bindings as DuckDB expressions; a query's SQL starts with those that it needs.
SQL = {
    "lv": """lv as (select user_id as stream_id, idx, idx * 0.5::double as start_s, idx * 0.5::double + 0.5::double as end_s, rms from (
      select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, value as rms from events))""",
    "fr": """fr as (select stream_id, idx, start_s as time_s,
      cast(coalesce(sum(cast(floor(rms) as bigint) + 1) over (partition by stream_id order by idx rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset",
      cast(floor(rms) as bigint) + 1 as length, 22050 as samples, 44100 as sample_rate from lv)""",
    "ti": """ti as (select user_id as stream_id, row_number() over (partition by user_id order by ts, event_id) as seq, event_type as title,
      cast(floor(epoch_us(ts) / 1000000) as bigint) as t from events)""",
    "pc": "pc as (select stream_id, idx as i, (cast(round_even(rms * 100, 0) as int) % 32768) - 16384 as sample from lv)",
    "ve": "ve as (select label as stream_id, row_number() over (partition by label order by vec_id) - 1 as idx, list_transform(embedding, lambda x: cast(x as double)) as vec from embeddings)",
    "rg": """rg as (select stream_id, seq, cast(e as bigint) - size as start_offset, cast(e as bigint) as end_offset, gap = 1 as is_gap from (
      select *, sum(size + 10 * gap) over (partition by stream_id order by seq rows between unbounded preceding and current row) as e from (
        select l_orderkey as stream_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as seq,
          cast(l_quantity as bigint) as size, case when l_returnflag = 'R' then 1 else 0 end as gap from lineitem)))""",
}
NEEDS = {"fr": ("lv",), "pc": ("lv",)}


def with_sql(names: str, body: str, recursive: bool = False) -> str:
    """body after the named bindings and those they need."""
    wanted: list[str] = []
    for name in names.split():
        wanted += [n for n in (*NEEDS.get(name, ()), name) if n not in wanted]
    return f"with {'recursive ' * recursive}" + ",\n".join(SQL[n] for n in wanted) + ("," if not body.lstrip().startswith("select") else "") + "\n" + body
