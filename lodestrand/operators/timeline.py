"""As-of, nearest and interval joins over a timeline, frame alignment, windows of frames.

As-of joins are windows over the union of both sides. A stream is cut into buckets of its axis, and each bucket takes over
the last row before it from a window over bucket aggregates, so one long stream spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _placed(probes: DataFrame, rows: DataFrame, at: str, pos: str, tie: str, width: float, by: str, back: bool, ahead: bool) -> DataFrame:
    """probes with __back, the last row with pos <= at, and __next, the first with pos > at, as asked for: one shuffle by (stream, bucket), shared by the windows and by the buckets' ends."""
    keep = F.struct(*rows.columns)
    left = probes.select(by, F.col(at).cast("double").alias("__p"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__tie"), F.struct(*probes.columns).alias("__probe"), F.lit(None).cast(rows.select(keep.alias("r")).schema["r"].dataType).alias("__row"))
    right = rows.select(by, F.col(pos).cast("double").alias("__p"), F.lit(0).alias("__kind"), F.col(tie).cast("long").alias("__tie"), F.lit(None).cast(left.schema["__probe"].dataType).alias("__probe"), keep.alias("__row"))
    both = left.unionByName(right).withColumn("__b", F.floor(F.col("__p") / width)).repartition(by, "__b")
    order = Window.partitionBy(by, "__b").orderBy("__p", "__kind", "__tie")
    ends = Window.partitionBy(by).orderBy("__b")
    found, hits = both, []
    tops = both.groupBy(by, "__b")
    aggs, carried = [], []
    place = F.when(F.col("__kind") == 0, F.struct("__p", "__tie"))
    if back:
        found = found.withColumn("__in_back", F.last("__row", ignorenulls=True).over(order))
        aggs.append(F.max_by("__row", place).alias("__top"))
        carried.append(F.last("__top", ignorenulls=True).over(ends.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
        hits.append(F.coalesce("__in_back", "__before").alias("__back"))
    if ahead:
        found = found.withColumn("__in_next", F.first("__row", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
        aggs.append(F.min_by("__row", place).alias("__low"))
        carried.append(F.first("__low", ignorenulls=True).over(ends.rowsBetween(1, Window.unboundedFollowing)).alias("__after"))
        hits.append(F.coalesce("__in_next", "__after").alias("__next"))
    tops = tops.agg(*aggs).select(by, "__b", *carried)
    return found.where("__kind = 1").join(tops, [by, "__b"]).select("__probe.*", *hits)


def placed(probes: DataFrame, rows: DataFrame, at: str, pos: str, tie: str = "idx", width: float = 64, by: str = "stream_id") -> DataFrame:
    """probes with `before`, the last row with pos <= at, and `after`, the first with pos > at; null where there is none."""
    return _placed(probes, rows, at, pos, tie, width, by, True, True).withColumnsRenamed({"__back": "before", "__next": "after"})


def as_of(probes: DataFrame, rows: DataFrame, at: str, pos: str, tie: str = "idx", forward: bool = False, width: float = 4096, by: str = "stream_id") -> DataFrame:
    """probes and `hit`, a struct of the last row with pos <= at (forward: the first with pos > at); null where there is none."""
    out = _placed(probes, rows, at, pos, tie, width, by, not forward, forward)
    return out.withColumnRenamed("__next" if forward else "__back", "hit")


def at_or_before(probes: DataFrame, frames: DataFrame, at: str, by: str = "stream_id") -> DataFrame:
    """The last frame with offset <= at; the first frame where at is before all."""
    first = frames.groupBy(by).agg(F.min_by(F.struct(*frames.columns), F.struct("offset", "idx")).alias("__first"))
    out = as_of(probes, frames, at, "offset", by=by).join(first, by)
    return out.withColumn("hit", F.coalesce("hit", "__first")).drop("__first")


def at_or_after(probes: DataFrame, frames: DataFrame, at: str, by: str = "stream_id") -> DataFrame:
    """The first frame whose end is after at."""
    return as_of(probes, frames.withColumn("end_offset", F.col("offset") + F.col("length")), at, "end_offset", forward=True, by=by)


def containing(probes: DataFrame, frames: DataFrame, at: str, by: str = "stream_id") -> DataFrame:
    """The frame with offset <= at < offset + length; null where there is none."""
    out = as_of(probes, frames, at, "offset", by=by)
    return out.withColumn("hit", F.when(F.col(at) < F.col("hit.offset") + F.col("hit.length"), F.col("hit")))


def nearest(probes: DataFrame, rows: DataFrame, at: str, pos: str = "time_s", width: float = 64, by: str = "stream_id") -> DataFrame:
    """The row nearest to at, the earlier of two as near. A stream's rows have different places, as frames last."""
    both = _placed(probes, rows, at, pos, "idx", width, by, True, True)
    gap = lambda side: F.abs(F.col(f"{side}.{pos}") - F.col(at))
    hit = F.when(F.col("__back").isNull() | (gap("__next") < gap("__back")), F.col("__next")).otherwise(F.col("__back"))
    return both.select(*probes.columns, hit.alias("hit"))


def near(left: DataFrame, right: DataFrame, at: str, pos: str, radius: float, by: str = "stream_id") -> DataFrame:
    """All pairs within radius: an equi join on buckets as wide as the radius, of which the left side takes three."""
    width = float(radius)
    a = left.withColumn("__b", F.explode(F.array(*[F.floor(F.col(at) / width) + d for d in (-1, 0, 1)])))
    b = right.withColumn("__b", F.floor(F.col(pos) / width))
    return a.join(b, [by, "__b"]).where(F.abs(F.col(at) - F.col(pos)) <= radius).drop("__b")


def bounds(frames: DataFrame, by: str = "stream_id") -> DataFrame:
    """first_s, last_end_s of each timeline, and its bytes."""
    end = F.col("time_s") + F.col("samples") / F.col("sample_rate")
    return frames.groupBy(by).agg(F.min("time_s").alias("first_s"), F.max(end).alias("last_end_s"), F.min("offset").alias("first_offset"), F.max(F.col("offset") + F.col("length")).alias("end_offset"))


def aligned(decisions: DataFrame, frames: DataFrame, by: str = "stream_id") -> DataFrame:
    """decisions(kind, incoming_start_s, outgoing_end_s) with incoming_offset, outgoing_offset and split_kind.

    Edges go to the nearest frame starts. Times outside the timeline, collapsed crossfades and inverted exclusions are ERROR
    with null offsets; an exclusion whose edges meet is a HARD_CUT.
    """
    names = decisions.columns
    edges = decisions.withColumn("__d", F.struct(*names)).select(by, "__d", F.posexplode(F.array("incoming_start_s", "outgoing_end_s")).alias("__edge", "__at"))
    edge = lambda i, c: F.when(F.col("__edge") == i, c)
    # both edges of a decision meet again by its values: a number that is dealt to rows needn't be the same in a plan that reads them twice
    found = nearest(edges, frames, "__at", by=by).groupBy(by, "__d").agg(*[F.max(edge(i, F.col("hit.offset"))).alias(n) for i, n in enumerate(("__in", "__out"))], F.greatest(*[F.count(edge(i, F.lit(1))) for i in (0, 1)]).alias("__copies"))
    out = found.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select("__d.*", "__in", "__out").join(bounds(frames, by).select(by, "first_s", "last_end_s"), by)
    outside = F.lit(False)
    for t in ("incoming_start_s", "outgoing_end_s"):
        outside = outside | (F.col(t) < F.col("first_s")) | (F.col(t) > F.col("last_end_s"))
    kind = (
        F.when(outside, "ERROR")
        .when(F.col("kind") == "HARD_CUT", "HARD_CUT")
        .when((F.col("kind") == "CROSSFADE") & (F.col("__in") < F.col("__out")), "CROSSFADE")
        .when((F.col("kind") == "EXCLUSION") & (F.col("__in") == F.col("__out")), "HARD_CUT")
        .when((F.col("kind") == "EXCLUSION") & (F.col("__out") < F.col("__in")), "EXCLUSION")
        .otherwise("ERROR")
    )
    out = out.withColumn("split_kind", kind)
    ok = F.col("split_kind") != "ERROR"
    return out.select(*names, "split_kind", F.when(ok, F.col("__in")).alias("incoming_offset"), F.when(ok, F.when(F.col("split_kind") == "HARD_CUT", F.col("__in")).otherwise(F.col("__out"))).alias("outgoing_offset"))


def windows(candidates: DataFrame, frames: DataFrame, radius: float, at: str = "candidate_s", by: str = "stream_id") -> DataFrame:
    """Each candidate's frame-aligned window: from the frame nearest to max(0, at - radius) to the last that starts by at + radius."""
    names = candidates.columns
    out = nearest(candidates.withColumn("__from", F.greatest(F.lit(0.0), F.col(at) - radius)), frames, "__from", by=by).withColumnRenamed("hit", "__first")
    out = as_of(out.withColumn("__to", F.col(at) + radius), frames, "__to", "time_s", width=64, by=by).withColumnRenamed("hit", "__last")
    end = F.col("__last.time_s") + F.col("__last.samples") / F.col("__last.sample_rate")
    return out.select(
        *names, F.col("__first.offset").alias("start_offset"), (F.col("__last.offset") + F.col("__last.length")).alias("end_offset"), F.col("__first.time_s").alias("window_start_s"), end.alias("window_end_s"), (F.col("__last.idx") - F.col("__first.idx") + 1).alias("n_frames")
    ).where("start_offset < end_offset")


def timeline(frames: DataFrame, by: str = "stream_id") -> DataFrame:
    """frames with elapsed_s, the running sum of samples / sample_rate before each."""
    before = Window.partitionBy(by).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("elapsed_s", F.coalesce(F.sum(F.col("samples") / F.col("sample_rate")).over(before), F.lit(0.0)))


def retained(frames: DataFrame, max_bytes: int, by: str = "stream_id") -> DataFrame:
    """Frames that overlap the last max_bytes of their stream."""
    total = F.sum("length").over(Window.partitionBy(by))
    return frames.withColumn("ring_start", F.greatest(F.lit(0).cast("long"), total - max_bytes)).where("offset + length > ring_start")


def settled(candidates: DataFrame, ends: DataFrame, settle: float, at: str = "candidate_s", by: str = "stream_id") -> DataFrame:
    """Candidates for which the stream has gone on for `settle` seconds."""
    return candidates.join(ends, by).where(F.col("last_end_s") >= F.col(at) + settle).select(*candidates.columns)


def half_up_time(t: Column) -> Column:
    """Seconds to milliseconds, ties to even."""
    return F.bround(t * 1000).cast("long")
