"""Edges in time: means over horizons by prefix sums, multi-horizon change, and the verified edge near a provisional time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import timeline

BY = "stream_id"
HORIZONS = (0.5, 1.0, 2.0)


def prefix_means(levels: DataFrame, spans: DataFrame, by: str = BY) -> DataFrame:
    """spans(from_s, to_s) with n and mean_rms of the levels whose middle is in [from_s, to_s): differences of running sums at two as-of lookups."""
    middle = levels.withColumn("center_s", (F.col("start_s") + F.col("end_s")) / 2)
    w = Window.partitionBy(by).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    sums = middle.select(by, "idx", "center_s", F.sum("rms").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("c"))
    names = spans.columns
    eps = 1e-9  # the left end of searchsorted: levels at the bound itself belong to the right
    x = timeline.as_of(spans.withColumn("__a", F.col("from_s") - eps), sums, "__a", "center_s", width=256, by=by).withColumnRenamed("hit", "__lo")
    x = timeline.as_of(x.withColumn("__z", F.col("to_s") - eps), sums, "__z", "center_s", width=256, by=by).withColumnRenamed("hit", "__hi")
    n = F.coalesce("__hi.c", F.lit(0)) - F.coalesce("__lo.c", F.lit(0))
    total = F.coalesce("__hi.s", F.lit(0.0)) - F.coalesce("__lo.s", F.lit(0.0))
    return x.select(*names, n.alias("n"), F.when(n > 0, total / n).alias("mean_rms"))


def edge_scan(levels: DataFrame, horizons=HORIZONS, seconds: float = 0.5, by: str = BY) -> DataFrame:
    """time_s, horizon_s, pre, post, energy at each level's start: |pre - post| / (pre + post), where both sides have levels."""
    w = Window.partitionBy(by).orderBy("idx")
    x = levels
    sides = []
    for h in horizons:
        n = round(h / seconds)
        x = x.withColumn(f"a{n}", F.avg("rms").over(w.rangeBetween(-n, -1))).withColumn(f"b{n}", F.avg("rms").over(w.rangeBetween(0, n - 1)))
        sides.append(F.struct(F.lit(float(h)).alias("horizon_s"), F.col(f"a{n}").alias("pre"), F.col(f"b{n}").alias("post")))
    x = x.select(by, F.col("start_s").alias("time_s"), F.explode(F.array(*sides)).alias("e")).select(by, "time_s", "e.*").where("pre is not null and post is not null")
    return x.withColumn("energy", F.abs(F.col("pre") - F.col("post")) / F.greatest(F.col("pre") + F.col("post"), F.lit(1e-12)))


def temporal_edge(scan: DataFrame, provisional: DataFrame, radius: float = 2.0, least: float = 0.25, signal: float = 0.005, by: str = BY) -> DataFrame:
    """For each provisional(provisional_s) the time within radius whose two shortest horizons change the same way by `least` or more; the largest change, then the nearest, then the earliest."""
    pair = scan.where(F.col("horizon_s") <= HORIZONS[1]).groupBy(by, "time_s").agg(
        F.count(F.lit(1)).alias("n"), F.min("energy").alias("least"), F.min(F.signum(F.col("post") - F.col("pre"))).alias("lo"), F.max(F.signum(F.col("post") - F.col("pre"))).alias("hi"), F.max(F.greatest("pre", "post")).alias("top")
    )
    pair = pair.where((F.col("n") == 2) & (F.col("least") >= least) & (F.col("lo") == F.col("hi")) & (F.col("lo") != 0) & (F.col("top") >= signal))
    both = timeline.near(provisional, pair, "provisional_s", "time_s", radius, by)
    order = F.struct(-F.col("least"), F.abs(F.col("time_s") - F.col("provisional_s")), "time_s")
    best = both.groupBy(*provisional.columns).agg(F.min_by(F.struct("time_s", "least", "hi"), order).alias("b"))
    return best.select(*provisional.columns, F.col("b.time_s").alias("edge_s"), F.round("b.least", 6).alias("energy"), F.when(F.col("b.hi") > 0, "RISING").otherwise("FALLING").alias("direction"))


def shared_edge(scan: DataFrame, provisional: DataFrame, radius: float = 0.5, least: float = 0.25, signal: float = 1e-4, handoff: DataFrame | None = None, by: str = BY) -> DataFrame:
    """For each provisional(k, provisional_s) an earlier edge: a spectral handoff (k, handoff_s), where there is one, else the latest of the strongest times in [provisional - radius, provisional) at which the two shortest horizons rise together by `least` or more.

    scan(time_s, horizon_s, pre, post, energy, spectral).
    """
    pair = scan.where(F.col("horizon_s") <= HORIZONS[1]).groupBy(by, "time_s").agg(
        F.count(F.lit(1)).alias("n"), F.min("energy").alias("energy"), F.min("spectral").alias("spectral"), F.min(F.col("post") - F.col("pre")).alias("rise"), F.max("post").alias("top")
    )
    pair = pair.where((F.col("n") == 2) & (F.col("energy") >= least) & (F.col("rise") > 0) & (F.col("top") >= signal))
    both = timeline.near(provisional, pair, "provisional_s", "time_s", radius, by).where("time_s < provisional_s")
    best = both.groupBy(*provisional.columns).agg(F.max(F.struct("energy", "spectral", "time_s")).alias("b"))
    out = provisional.join(best, provisional.columns, "left")
    if handoff is not None:
        out = out.join(handoff, [by, "k"], "left")
        out = out.withColumn("b", F.when(F.col("handoff_s") < F.col("provisional_s"), F.struct(F.lit(None).cast("double").alias("energy"), F.lit(None).cast("double").alias("spectral"), F.col("handoff_s").alias("time_s"))).otherwise(F.col("b")))
    return out.where("b is not null").select(*provisional.columns, F.col("b.time_s").alias("edge_s"), F.round("b.energy", 6).alias("energy"), F.round("b.spectral", 6).alias("spectral"))


def spectral_handoff(scores: DataFrame, references: DataFrame, radius: float = 8.0, least: float = 0.45, above: float = 0.06, apart: float = 1.0, by: str = BY) -> DataFrame:
    """k, handoff_s: the highest of scores(time_s, score) around each reference(k, reference_s), if it is `least` or more, and `above` more than any peak that is `apart` seconds away. A peak is as high as its neighbours."""
    w = Window.partitionBy(by).orderBy("time_s")
    x = scores.withColumn("peak", F.coalesce(F.col("score") >= F.lag("score").over(w), F.lit(True)) & F.coalesce(F.col("score") >= F.lead("score").over(w), F.lit(True)))
    near = timeline.near(references, x, "reference_s", "time_s", radius, by)
    best = near.groupBy(by, "k").agg(F.max(F.struct("score", (-F.col("time_s")).alias("back"))).alias("b"))
    best = best.select(by, "k", F.col("b.score").alias("top"), (-F.col("b.back")).alias("handoff_s")).where(F.col("top") >= least)
    other = near.join(best, [by, "k"]).where(F.col("peak") & (F.abs(F.col("time_s") - F.col("handoff_s")) >= apart)).groupBy(by, "k").agg(F.max("score").alias("other"))
    return best.join(other, [by, "k"], "left").where(F.col("other").isNull() | (F.col("top") - F.col("other") >= above)).select(by, "k", "handoff_s")


def handoff_scores(vectors: DataFrame, sides: tuple[int, ...], distance, by: str = BY) -> DataFrame:
    """by, idx, score: the least, over sides, of the distance between the mean vectors before and from each on; only where all sides are whole."""
    w = Window.partitionBy(by, "dim").orderBy("idx")
    x = vectors.select(by, "idx", F.posexplode("vec").alias("dim", "x"))
    for n in sides:
        before, after = w.rowsBetween(-n, -1), w.rowsBetween(0, n - 1)
        x = x.withColumn(f"a{n}", F.when(F.count("x").over(before) == n, F.avg("x").over(before))).withColumn(f"b{n}", F.when(F.count("x").over(after) == n, F.avg("x").over(after)))
    whole = " and ".join(f"a{n} is not null and b{n} is not null" for n in sides)
    names = [f"{s}{n}" for n in sides for s in "ab"]
    y = x.where(whole).groupBy(by, "idx").agg(F.array_sort(F.collect_list(F.struct("dim", *names))).alias("v"))
    side = lambda name: F.transform("v", lambda e: e[name])
    return y.select(by, "idx", F.least(*[distance(side(f"a{n}"), side(f"b{n}")) for n in sides], F.lit(float("inf"))).alias("score"))
