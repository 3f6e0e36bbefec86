"""State along a stream: which transitions can be written, which segment is open, which tracks follow one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import timeline
from .detect import fold

BY = "stream_id"


def written(transitions: DataFrame, by: str = BY) -> DataFrame:
    """transitions(n, outgoing_end, incoming_start) that can be written in turn, with the open start before each (null for the first): both edges must be after it; what can't is passed over."""

    def step(pdf):
        start, out = None, []
        for n, end, begin in zip(pdf["n"], pdf["outgoing_end"], pdf["incoming_start"]):
            if start is None or (end > start and begin > start):
                out.append((int(n), start, int(end), int(begin)))
                start = int(begin)
        return out

    return fold(transitions.select(by, "n", "outgoing_end", "incoming_start"), "n long, open_start long, outgoing_end long, incoming_start long", step, by, "n")


def autonomous(boundaries: DataFrame, least_open: float = 8.0, by: str = BY) -> DataFrame:
    """HIGH boundaries(n, time_s, confidence) that close the open segment, which they do `least_open` seconds after its start: n, start_s, time_s. The first opens one."""

    def step(pdf):
        start, out = None, []
        for n, t in zip(pdf["n"], pdf["time_s"]):
            if start is None:
                start = t
            elif t - start >= least_open:
                out.append((int(n), start, t))
                start = t
        return out

    return fold(boundaries.where("confidence = 'HIGH'").select(by, "n", "time_s"), "n long, start_s double, time_s double", step, by, "n")


def track_transitions(tracks: DataFrame, by: str = BY) -> DataFrame:
    """From each track(n, boundary_s) to the next: outgoing_n, incoming_n, boundary_s. The first only opens the session; a track without a boundary keeps its place, so those behind it wait."""
    w = Window.partitionBy(by).orderBy("n")
    x = tracks.withColumn("nth", F.row_number().over(w)).withColumn("outgoing_n", F.lag("n").over(w))
    waits = F.max(F.when((F.col("nth") > 1) & F.col("boundary_s").isNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("waits", waits).where("nth > 1 and waits = 0").select(by, "outgoing_n", F.col("n").alias("incoming_n"), "boundary_s")


def stale(transitions: DataFrame, frames: DataFrame, by: str = BY) -> DataFrame:
    """transitions(n, open_start, incoming_offset: where the next title began) whose edges aren't after the open start, cut at the first frame that ends after that offset: cut_s, cut_offset; null where there is no such frame, or it isn't after the open start."""
    found = timeline.at_or_after(transitions, frames, "incoming_offset", by=by)
    ok = F.col("hit.offset") > F.col("open_start")
    return found.select(*transitions.columns, F.when(ok, F.col("hit.time_s")).alias("cut_s"), F.when(ok, F.col("hit.offset")).alias("cut_offset"))


def timed(events: DataFrame, frames: DataFrame, by: str = BY) -> DataFrame:
    """events(audio_offset) with time_s, that of the first frame that ends after the offset; null while none has come."""
    found = timeline.at_or_after(events, frames, "audio_offset", by=by)
    return found.select(*events.columns, F.col("hit.time_s").alias("time_s"))


def proposed_until(candidates: DataFrame, ends: DataFrame, by: str = BY) -> DataFrame:
    """candidates(candidate_s) with batch: the first of ends(batch, end_s) that has come to them. A batch is asked for (the end before, its own end]; null: none yet."""
    eps = 1e-9
    found = timeline.as_of(candidates.withColumn("__at", F.col("candidate_s") - eps), ends.select(by, "batch", "end_s", F.col("batch").alias("idx")), "__at", "end_s", forward=True, width=64, by=by)
    return found.select(*candidates.columns, F.col("hit.batch").alias("batch"))


def promoted(hypotheses: DataFrame, frames: DataFrame, by: str = BY) -> DataFrame:
    """HIGH hypotheses(hyp_id, time_s, confidence) as cuts at their time, aligned to frames; others are left alone."""
    cuts = hypotheses.where("confidence = 'HIGH'").select(by, "hyp_id", F.lit("HARD_CUT").alias("kind"), F.col("time_s").alias("incoming_start_s"), F.col("time_s").alias("outgoing_end_s"))
    return timeline.aligned(cuts, frames, by).where("split_kind <> 'ERROR'")


def scan_times(anchors: DataFrame, radius: float, step: float, by: str = BY) -> DataFrame:
    """time_s, anchor_n: grids of `step` around anchors(n, anchor_s), a time once (by nine digits), of the last anchor that has it."""
    n = round(2 * radius / step)
    t = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.round(F.col("anchor_s") - radius + i * step, 9)))
    return anchors.select(by, "n", t.alias("time_s")).where("time_s >= 0").groupBy(by, "time_s").agg(F.max("n").alias("anchor_n"))


def search_bounds(times: str) -> Column:
    """The least and greatest of an array of landmark times, in their own order without repeats: struct(times, start_s, end_s); null without any."""
    distinct = f"array_distinct(filter({times}, t -> t is not null))"
    return F.expr(f"if(size({distinct}) = 0, null, named_struct('times', {distinct}, 'start_s', array_min({distinct}), 'end_s', array_max({distinct})))")
