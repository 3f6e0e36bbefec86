"""Byte ranges: plans of splits, segments over resolutions, the coverage ledger, names and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = "stream_id"


def planned(splits: DataFrame, crossfade_unowned: bool = False) -> DataFrame:
    """One row a range of splits(previous_start, next_end, incoming_offset, outgoing_offset, split_kind): role outgoing, unowned or incoming.

    Splits whose edges lie outside the writable range give none. With crossfade_unowned a crossfade's bytes are unowned, once.
    """
    i, o, a, z = F.col("incoming_offset"), F.col("outgoing_offset"), F.col("previous_start"), F.col("next_end")
    part = lambda role, start, end: F.struct(F.lit(role).alias("role"), start.alias("start_offset"), end.alias("end_offset"))
    cross = F.array(part("outgoing", a, i), part("unowned", i, o), part("incoming", o, z))
    plain = F.array(part("outgoing", a, o), part("incoming", i, z), part("unowned", o, i))
    plan = F.when((F.col("split_kind") == "CROSSFADE") & F.lit(crossfade_unowned), cross).otherwise(F.when(i > o, plain).otherwise(F.slice(plain, 1, 2)))
    valid = (a >= 0) & (z > a) & (a < o) & (o <= z) & (a <= i) & (i < z)
    return splits.where(valid).withColumn("r", F.explode(plan)).select(*splits.columns, "r.*")


def segments(resolutions: DataFrame, ends: DataFrame, min_tail: float, by: str = BY) -> DataFrame:
    """index, start_offset, end_offset: a segment up to each resolution's outgoing edge and the tail.

    resolutions(n, incoming_offset, outgoing_offset, incoming_start_s) in order; ends(end_offset, last_end_s). If the last one
    leaves under min_tail seconds, the last segment runs to the end.
    """
    w = Window.partitionBy(by).orderBy("n")
    x = resolutions.join(ends, by)
    start = F.coalesce(F.lag("incoming_offset").over(w), F.col("first_offset"))
    x = x.withColumn("start_offset", start).withColumn("following", F.lead("n").over(w)).withColumn("index", F.row_number().over(w))
    short = F.col("following").isNull() & (F.greatest(F.lit(0.0), F.col("last_end_s") - F.col("incoming_start_s")) < min_tail)
    part = lambda n, a, z: F.struct(n.alias("index"), a.alias("start_offset"), z.alias("end_offset"))
    own = part(F.col("index"), F.col("start_offset"), F.when(short, F.col("end_offset")).otherwise(F.col("outgoing_offset")))
    tail = part(F.col("index") + 1, F.col("incoming_offset"), F.col("end_offset"))
    parts = F.when(F.col("following").isNull() & ~short, F.array(own, tail)).otherwise(F.array(own))
    return x.select(by, F.explode(parts).alias("s")).select(by, "s.*")


def ledger(ranges: DataFrame, by: str = BY) -> DataFrame:
    """ranges(seq, start_offset, end_offset) with covered (the end before each) and status: OK, GAP, OVERLAP (extends) or INSIDE."""
    w = Window.partitionBy(by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    x = ranges.withColumn("covered", F.coalesce(F.max("end_offset").over(w), F.lit(0).cast("long")))
    status = F.when(F.col("start_offset") > F.col("covered"), "GAP").when(F.col("start_offset") == F.col("covered"), "OK").when(F.col("end_offset") > F.col("covered"), "OVERLAP").otherwise("INSIDE")
    return x.withColumn("status", status)


def terminal(ledger_: DataFrame, by: str = BY) -> DataFrame:
    """One record a stream: ranges, covered_end, gaps, gap_bytes, and whether coverage is complete."""
    gap = F.col("status") == "GAP"
    return ledger_.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_ranges"), F.max("end_offset").alias("covered_end"), F.count(F.when(gap, 1)).alias("n_gaps"), F.coalesce(F.sum(F.when(gap, F.col("start_offset") - F.col("covered"))), F.lit(0).cast("long")).alias("gap_bytes"), F.min(F.col("status") == "OK").alias("complete")
    )


def numbered_stems(rows: DataFrame, stem: str, order: str, width: int = 4096) -> DataFrame:
    """rows with name: the stem, and -2, -3 ... for those that follow with the same stem, by a whole number `order`. A stem that many share is numbered in ranges of the order, so that it spreads over tasks."""
    x = rows.withColumn("__b", F.floor(F.col(order) / width))
    w = Window.partitionBy(stem).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = x.groupBy(stem, "__b").agg(F.count(F.lit(1)).alias("__c")).withColumn("__ahead", F.coalesce(F.sum("__c").over(w), F.lit(0))).drop("__c")
    x = x.withColumn("__n", F.row_number().over(Window.partitionBy(stem, "__b").orderBy(order))).join(ahead, [stem, "__b"])
    n = F.col("__n") + F.col("__ahead")
    return x.withColumn("name", F.when(n == 1, F.col(stem)).otherwise(F.concat_ws("-", F.col(stem), n.cast("string")))).select(*rows.columns, "name")


def trace(contexts: DataFrame, keys: tuple[str, ...] = (BY, "k")) -> DataFrame:
    """keys and record: each routing observation as one line of JSON, its fields in order of name."""
    fields = sorted(c for c in contexts.columns if c not in keys)
    return contexts.select(*keys, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))


def provenance(columns: list[Column]) -> Column:
    """A JSON record with sorted keys."""
    return F.to_json(F.struct(*columns))
