"""Boundary candidates, and the default way from a candidate to a decision: local minima, match, relation, policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import timeline

MATCH_RADIUS = 8.0
QUIET_RADIUS, QUIET_RATIO = 2.0, 10.0
DIVERGENCE = 3.0
#: Boundaries of a file that are broadcast at most.
MOST_BROADCAST = 100_000


def fixed(ends: DataFrame, interval: float, end: str = "last_end_s", by: str = "stream_id") -> DataFrame:
    """by, k, candidate_s = k * interval in (0, end]."""
    last = F.floor(F.col(end) / interval).cast("long")
    out = ends.where(last >= 1).select(by, F.explode(F.sequence(F.lit(1).cast("long"), last)).alias("k"))
    return out.withColumn("candidate_s", F.col("k") * F.lit(float(interval)))


def manual(ends: DataFrame, times: list[float], start: float = 0.0, end: str = "last_end_s", by: str = "stream_id") -> DataFrame:
    """Sorted distinct times in (start, end], with their rank."""
    out = ends.select(by, end, F.posexplode(F.array_sort(F.array_distinct(F.array(*map(F.lit, times))))).alias("pos", "candidate_s")).where((F.col("candidate_s") > start) & (F.col("candidate_s") <= F.col(end)))
    return out.select(by, F.row_number().over(Window.partitionBy(by).orderBy("candidate_s")).alias("n"), "candidate_s")


def external(ends: DataFrame, boundaries: DataFrame, start: float = 0.0, end: str = "last_end_s", by: str = "stream_id") -> DataFrame:
    """boundaries(time_seconds, source, reference_offset) in (start, end], duplicates kept, ordered by time, source, reference (null: -1): of their own stream, if they name one, else of all."""
    order = Window.partitionBy(by).orderBy("time_seconds", "source", F.coalesce("reference_offset", F.lit(-1)))
    if "stream_id" in boundaries.columns:  # each of one stream
        out = ends.join(boundaries, by)
    else:  # all of every stream: the result has streams x boundaries rows, whatever the join
        out = ends.crossJoin(F.broadcast(boundaries) if boundaries.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else boundaries)
    out = out.where((F.col("time_seconds") > start) & (F.col("time_seconds") <= F.col(end)))
    return out.select(by, F.row_number().over(order).alias("n"), "time_seconds", "source", "reference_offset")


def local_minima(levels: DataFrame, by: str = "stream_id") -> DataFrame:
    """Levels that are no higher than their neighbours (plateaus and ends pass): minimum_s is the middle."""
    w = Window.partitionBy(by).orderBy("idx")
    before, after = F.lag("rms").over(w), F.lead("rms").over(w)
    out = levels.withColumn("__b", before).withColumn("__a", after).where("(__b is null or rms <= __b) and (__a is null or rms <= __a)")
    return out.select(by, "idx", ((F.col("start_s") + F.col("end_s")) / 2).alias("minimum_s"), "rms")


def matched(candidates: DataFrame, minima: DataFrame, radius: float = MATCH_RADIUS, by: str = "stream_id") -> DataFrame:
    """candidates with acoustic_s, acoustic_rms: the nearest minimum, or a much quieter one shortly before it."""
    pairs = timeline.near(candidates, minima.select(by, "minimum_s", "rms"), "candidate_s", "minimum_s", radius, by)
    gap = F.abs(F.col("minimum_s") - F.col("candidate_s"))
    hit = F.struct("minimum_s", "rms")
    earlier = (F.col("minimum_s") < F.col("candidate_s")) & (gap <= QUIET_RADIUS)
    out = pairs.groupBy(*candidates.columns).agg(F.min_by(hit, F.struct(gap, "rms", "minimum_s")).alias("s"), F.min_by(hit, F.when(earlier, F.struct("rms", gap, "minimum_s"))).alias("q"))
    quieter = (F.col("s.minimum_s") > F.col("candidate_s")) & (((F.col("q.rms") == 0) & (F.col("s.rms") > 0)) | ((F.col("q.rms") > 0) & (F.col("s.rms") / F.col("q.rms") >= QUIET_RATIO)))
    chosen = F.when(F.coalesce(quieter, F.lit(False)), F.col("q")).otherwise(F.col("s"))
    return out.withColumn("c", chosen).select(*candidates.columns, F.col("c.minimum_s").alias("acoustic_s"), F.col("c.rms").alias("acoustic_rms"))


def decided(matches: DataFrame, divergence: float = DIVERGENCE) -> DataFrame:
    """relation of the candidate's time to the acoustic one, and the decision: kind, incoming_start_s, outgoing_end_s."""
    signed = F.col("candidate_s") - F.col("acoustic_s")
    relation = F.when(signed > divergence, "ACOUSTIC_EARLIER").when(signed < -divergence, "SEMANTIC_EARLIER").otherwise("AGREEMENT")
    out = matches.withColumn("relation", relation).withColumn("kind", F.when(F.col("relation") == "ACOUSTIC_EARLIER", "CROSSFADE").otherwise("HARD_CUT"))
    cut = F.least("candidate_s", "acoustic_s")
    return out.withColumn("incoming_start_s", F.when(F.col("relation") == "AGREEMENT", cut).otherwise(F.col("acoustic_s"))).withColumn(
        "outgoing_end_s", F.when(F.col("relation") == "AGREEMENT", cut).when(F.col("relation") == "ACOUSTIC_EARLIER", F.col("candidate_s")).otherwise(F.col("acoustic_s"))
    )


def resolve_default(levels: DataFrame, frames: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with a minimum in reach, decided and aligned to frames."""
    return timeline.aligned(decided(matched(candidates, local_minima(levels))), frames)
