"""Bytes of streams as tables: chunks of a fixed size, ranges read from them, retention, and the checks that a range must pass.

chunks(stream_id, chunk, start_offset, data): chunk is start_offset / size, so a range finds its chunks by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = "stream_id"
CHUNK = 1 << 20
#: Bytes that a file may hold, that a disk must keep free, that a second writes; what room a file's finishing takes.
MOST_BYTES, RESERVE_BYTES, BYTES_A_SECOND, ROOM = 8 << 30, 512 << 20, 8 << 20, 1.25
LEAST_SECONDS = 30.0


def spooled(pieces: DataFrame, size: int = CHUNK, by: str = BY) -> DataFrame:
    """Chunks of `size` bytes of pieces(start_offset, data), which follow one another. A piece is cut where a chunk ends."""
    length = F.octet_length("data")
    first, last = F.floor(F.col("start_offset") / size), F.floor((F.col("start_offset") + length - 1) / size)
    x = pieces.where(length > 0).select(by, "start_offset", "data", F.explode(F.sequence(first, last)).alias("chunk"))
    a = F.greatest("start_offset", F.col("chunk") * size)
    z = F.least(F.col("start_offset") + F.octet_length("data"), (F.col("chunk") + 1) * size)
    part = x.select(by, F.col("chunk").cast("long").alias("chunk"), F.struct(a.alias("at"), F.substring("data", (a - F.col("start_offset") + 1).cast("int"), (z - a).cast("int")).alias("data")).alias("p"))
    joined = F.aggregate(F.array_sort(F.collect_list("p")), F.lit(b"").cast("binary"), lambda s, p: F.concat(s, p["data"]))
    return part.groupBy(by, "chunk").agg(F.min("p.at").alias("start_offset"), joined.alias("data"))


def inventory(chunks: DataFrame, by: str = BY) -> DataFrame:
    """What is retained of each stream: n_chunks, start_offset, end_offset, and whether its chunks follow one another."""
    w = Window.partitionBy(by).orderBy("start_offset")
    end = F.col("start_offset") + F.octet_length("data")
    x = chunks.select(by, "start_offset", end.alias("end_offset"), (F.lag(end).over(w) != F.col("start_offset")).alias("hole"))
    return x.groupBy(by).agg(F.count(F.lit(1)).alias("n_chunks"), F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"), (F.count(F.when(F.col("hole"), 1)) == 0).alias("contiguous"))


def discarded(chunks: DataFrame, starts: DataFrame, by: str = BY) -> DataFrame:
    """Chunks that reach beyond each stream's start (starts(start): its logical start); whole chunks before it go."""
    return chunks.join(starts, by).where(F.col("start_offset") + F.octet_length("data") > F.col("start")).select(*chunks.columns)


def retained(start: Column, end: Column, first: Column, last: Column) -> Column:
    """Whether [start, end) can be read of [first, last)."""
    return (start >= 0) & (start <= end) & (first <= start) & (end <= last)


def read(chunks: DataFrame, ranges: DataFrame, piece: int, size: int = CHUNK, by: str = BY) -> DataFrame:
    """Pieces of at most `piece` bytes of ranges(range, start_offset, end_offset), in order: range, piece, at, data; data is null where not all of a piece is retained."""
    ids = [by, "range", "piece", "at", "to"]
    at = F.explode(F.sequence(F.col("start_offset"), F.col("end_offset") - 1, F.lit(piece).cast("long")))
    x = ranges.where("end_offset > start_offset").select(by, "range", "start_offset", "end_offset", at.alias("at"))
    x = x.select(by, "range", ((F.col("at") - F.col("start_offset")) / piece).cast("long").alias("piece"), "at", F.least(F.col("at") + piece, "end_offset").alias("to"))
    x = x.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("to") - 1) / size)))).withColumn("chunk", F.col("chunk").cast("long"))
    y = x.join(chunks.select(by, "chunk", F.col("start_offset").alias("c"), "data"), [by, "chunk"], "left")
    a, z = F.greatest("at", "c"), F.least("to", F.col("c") + F.octet_length("data"))
    part = F.when(z > a, F.struct(a.alias("at"), F.substring("data", (a - F.col("c") + 1).cast("int"), (z - a).cast("int")).alias("data")))
    joined = F.aggregate(F.array_sort(F.collect_list(part)), F.lit(b"").cast("binary"), lambda s, p: F.concat(s, p["data"]))
    out = y.groupBy(*ids).agg(joined.alias("data"))
    return out.select(by, "range", "piece", "at", F.when(F.octet_length("data") == F.col("to") - F.col("at"), F.col("data")).alias("data"))


def finalized(ledger: DataFrame, spools: DataFrame, by: str = BY) -> DataFrame:
    """The tail of each stream that no range covers, from what ranges cover to the spool's end; ERROR where coverage doesn't begin at 0, has a hole, or what is left was discarded.

    ledger: output.ledger; spools(spool_start, spool_end).
    """
    x = ledger.groupBy(by).agg(F.max("end_offset").alias("covered"), F.count(F.when(F.col("status") == "GAP", 1)).alias("holes"), F.min("start_offset").alias("begins"))
    x = spools.join(x, by, "left").withColumn("covered", F.coalesce("covered", F.lit(0).cast("long")))
    bad = (F.coalesce("holes", F.lit(0)) > 0) | (F.coalesce("begins", F.lit(0)) != 0) | (F.col("spool_start") > F.col("covered")) | (F.col("spool_end") < F.col("covered"))
    status = F.when(bad, "ERROR").when(F.col("covered") == F.col("spool_end"), "COMPLETE").otherwise("TAIL")
    x = x.withColumn("status", status)
    tail = F.col("status") == "TAIL"
    return x.select(by, "status", F.when(tail, F.col("covered")).alias("tail_start"), F.when(tail, F.col("spool_end")).alias("tail_end"))


def guards(files: DataFrame, most: int = MOST_BYTES, reserve: int = RESERVE_BYTES, rate: int = BYTES_A_SECOND, least: float = LEAST_SECONDS, room: float = ROOM) -> DataFrame:
    """files(size, free_bytes, codec, role) with needed_bytes, timeout_s, and whether a file may be written, and is kept as it is (short, unowned)."""
    needed = F.lit(reserve) + F.ceil(F.col("size") * room)
    out = files.withColumn("needed_bytes", needed.cast("long")).withColumn("timeout_s", F.greatest(F.lit(least), F.col("size") / rate))
    return out.withColumn("allowed", (F.col("size") <= most) & (F.col("free_bytes") >= F.col("needed_bytes"))).withColumn("kept_raw", (F.col("role") == "unowned") & (F.col("codec") == "mp3") & (F.col("size") < 4096))


RULES = {
    "unknown kind": "kind not in ('HARD_CUT', 'CROSSFADE', 'EXCLUSION')",
    "time below zero": "incoming_start_s < 0 or outgoing_end_s < 0",
    "cut with two times": "kind = 'HARD_CUT' and incoming_start_s <> outgoing_end_s",
    "crossfade without overlap": "kind = 'CROSSFADE' and incoming_start_s >= outgoing_end_s",
    "exclusion without gap": "kind = 'EXCLUSION' and outgoing_end_s >= incoming_start_s",
}


def violations(rules: dict[str, str] = RULES) -> Column:
    """The names of the rules that a row breaks, in their order; an empty array is a valid row."""
    return F.filter(F.array(*[F.when(F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda r: r.isNotNull())


def valid(rows: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """rows, of which one that breaks a rule raises an error with its names."""
    broken = violations(rules)
    return rows.where(F.when(F.size(broken) > 0, F.raise_error(F.concat_ws(", ", broken)).cast("boolean")).otherwise(F.lit(True)))
