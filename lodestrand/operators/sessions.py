"""Sessions over metadata events: title lifetimes, confirmation, exclusions, shadow cadence, replay differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import text as X

from .detect import fold

BY = "stream_id"


def islands(events: DataFrame, threshold: int, by: str = BY) -> DataFrame:
    """by, island, title, start_seq, start_t, seen_t (its first event that comes `threshold` after the start; null without), and next_t (the start of the next title; null while open)."""
    w = Window.partitionBy(by).orderBy("seq")
    x = events.withColumn("new", F.when(F.lag("title").over(w).eqNullSafe(F.col("title")), 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    x = x.withColumn("start_t", F.last(F.when(F.col("new") == 1, F.col("t")), ignorenulls=True).over(w))
    x = x.groupBy(by, "island").agg(F.min_by("title", "seq").alias("title"), F.min("seq").alias("start_seq"), F.min("start_t").alias("start_t"), F.min(F.when(F.col("t") - F.col("start_t") >= threshold, F.col("t"))).alias("seen_t"))
    return x.withColumn("next_t", F.lead("start_t").over(Window.partitionBy(by).orderBy("island")))


def lifetimes(events: DataFrame, threshold: int, by: str = BY) -> DataFrame:
    """A decision for each title that ended: HARD_CUT if it lasted or was confirmed, else NO_BOUNDARY; confirmed_t: the first event, or the end, at which it had lasted long enough."""
    x = islands(events, threshold, by).where("next_t is not null")
    lifetime = F.col("next_t") - F.col("start_t")
    seen = F.coalesce("seen_t", F.when(lifetime >= threshold, F.col("next_t")))
    return x.select(by, F.col("island").cast("long").alias("island"), "title", "start_seq", "start_t", lifetime.alias("lifetime"), F.when(lifetime >= threshold, "HARD_CUT").otherwise("NO_BOUNDARY").alias("kind"), seen.alias("confirmed_t"))


def confirmed_by_clock(events: DataFrame, threshold: int, idle: int, by: str = BY) -> DataFrame:
    """The open title of each stream, if the stream (idle seconds past its last event) has outlasted the threshold and no event confirmed it."""
    last = events.groupBy(by).agg((F.max("t") + idle).alias("stream_end"))
    x = islands(events, threshold, by).where("next_t is null and seen_t is null").join(last, by)
    return x.where(F.col("stream_end") - F.col("start_t") >= threshold).select(by, "title", "start_t", F.col("stream_end").alias("confirmed_t"))


def exclusions(decisions: DataFrame, longest: int, positive: tuple[str, ...], negative: tuple[str, ...], by: str = BY) -> DataFrame:
    """Short unconfirmed titles that name a non-track, and whether the next title starts where they end and is confirmed (EXCLUSION), else NO_BOUNDARY."""
    w = Window.partitionBy(by).orderBy("island")
    x = decisions.withColumn("following", F.lead("kind").over(w)).withColumn("next_start", F.lead("start_t").over(w))
    x = x.where((F.col("kind") == "NO_BOUNDARY") & (F.col("lifetime") > 0) & (F.col("lifetime") <= longest) & X.marked(X.normal_title(F.col("title")), positive, negative))
    end = F.col("start_t") + F.col("lifetime")
    whole = (F.col("following") == "HARD_CUT") & (F.abs(F.col("next_start") - end) <= 1e-6)
    return x.select(by, "island", "title", "start_t", end.alias("end_t"), F.when(F.coalesce(whole, F.lit(False)), "EXCLUSION").otherwise("NO_BOUNDARY").alias("kind"))


def shadow_reports(hypotheses: DataFrame, ends: DataFrame, interval: float = 15.0, history: float = 120.0, apart: float = 3.0, margin: float = 6.0, before: float = 2.0, after: float = 2.0, by: str = BY) -> DataFrame:
    """When a live analysis, run each `interval` seconds on the last `history`, first reports each hypothesis.

    hypotheses(time_s), ends(end_s): the stream's end after each frame. A report needs a time past the last horizon and within
    this one (end - after - margin), context on both sides, and no report within `apart` before.
    """
    rows = hypotheses.select(by, F.lit(1).alias("kind"), F.col("time_s").alias("at")).unionByName(ends.select(by, F.lit(0).alias("kind"), F.col("end_s").alias("at")))

    def step(pdf):
        times = sorted(pdf.loc[pdf["kind"] == 1, "at"])
        last, done, reported, out = None, 0.0, [], []
        for end in sorted(pdf.loc[pdf["kind"] == 0, "at"]):
            if last is not None and end - last < interval:
                continue
            last = end
            horizon = max(0.0, end - after - margin)
            start = max(0.0, end - history)
            for t in times:
                if done < t <= horizon and t - start >= before and end - t >= after and all(abs(r - t) > apart for r in reported):
                    out.append((t, end))
                    reported.append(t)
            done = max(done, horizon)
        return out

    return fold(rows, "time_s double, reported_at_s double", step, by, "at")


def replay_difference(captured: DataFrame, replayed: DataFrame, by: str = BY) -> DataFrame:
    """by, n_captured, n_replayed, first_difference (position; null if the lists are equal)."""
    w = Window.partitionBy(by).orderBy("seq")
    number = lambda df, name: df.withColumn("pos", F.row_number().over(w) - 1).select(F.col(by).alias(f"{name}_k"), F.col("pos").alias(f"{name}_pos"), F.struct("title", "t").alias(name))
    a, b = number(captured, "a"), number(replayed, "b")
    both = a.join(b, (F.col("a_k") == F.col("b_k")) & (F.col("a_pos") == F.col("b_pos")), "full_outer")
    both = both.select(F.coalesce("a_k", "b_k").alias(by), F.coalesce("a_pos", "b_pos").alias("pos"), "a", "b")
    return both.groupBy(by).agg(F.count("a").alias("n_captured"), F.count("b").alias("n_replayed"), F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("pos").cast("long"))).alias("first_difference"))
