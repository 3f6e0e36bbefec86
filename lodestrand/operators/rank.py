"""Ranking and evidence over candidates and vectors: rank fusion, minimax, unions, robust scales, regimes, novelty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import vectors as V

from . import timeline

BY = "stream_id"


def family_rrf(candidates: DataFrame, by: str = BY) -> DataFrame:
    """candidates(time_s, d250, d500, d1, d2, mfcc_geo) with the ranks of three families and their reciprocal sum."""
    ranked = candidates
    for m in ("d250", "d500", "d1", "d2", "mfcc_geo"):
        ranked = ranked.withColumn(f"r_{m}", F.row_number().over(Window.partitionBy(by).orderBy(F.col(m).desc(), "time_s")))
    short = [F.col(f"r_{m}") for m in ("d250", "d500", "d1")]
    middle = sum(short[1:], short[0]) - F.greatest(*short) - F.least(*short)
    return ranked.withColumn("short_rank", middle).select(*candidates.columns, "short_rank", F.col("r_d2").alias("long_rank"), F.col("r_mfcc_geo").alias("regime_rank"), (1 / F.col("short_rank") + 1 / F.col("r_d2") + 1 / F.col("r_mfcc_geo")).alias("family_rrf"))


def minimax(candidates: DataFrame, by: str = BY) -> DataFrame:
    """Of candidates(time_s, family_rrf, forward_novelty) the one whose worse rank is best."""
    rank = lambda c: F.row_number().over(Window.partitionBy(by).orderBy(F.col(c).desc(), "time_s"))
    x = candidates.withColumn("rrf_rank", rank("family_rrf")).withColumn("novelty_rank", rank("forward_novelty"))
    order = F.struct(F.greatest("rrf_rank", "novelty_rank"), F.col("rrf_rank") + F.col("novelty_rank"), "rrf_rank", "novelty_rank", "time_s")
    return x.groupBy(by).agg(F.min_by(F.struct("time_s", "rrf_rank", "novelty_rank"), order).alias("b")).select(by, "b.*")


def union_candidates(references: DataFrame, basins: DataFrame, series: DataFrame, nearest: float = 1.0, farthest: float = 7.0, by: str = BY) -> DataFrame:
    """For each reference(k, reference_s): basins(time_s) nearest..farthest before it, and the local maxima of series(time_s, strength) there, by milliseconds, with their sources in that order."""
    reach = F.col("reference_s") - F.col("time_s")
    met = lambda rows: timeline.near(references, rows, "reference_s", "time_s", farthest, by).where(reach.between(nearest, farthest))
    a = met(basins).select(by, "k", "time_s", F.lit(0).alias("o"), F.lit("BASIN").alias("source"))
    grid = met(series)
    w = Window.partitionBy(by, "k").orderBy("time_s")
    grid = grid.withColumn("b", F.lag("strength").over(w)).withColumn("n", F.lead("strength").over(w)).where("(b is null or strength >= b) and (n is null or strength >= n)")
    b = grid.select(by, "k", "time_s", F.lit(1).alias("o"), F.lit("D2").alias("source"))
    both = a.unionByName(b).withColumn("time_s", F.bround("time_s", 3))
    found = both.groupBy(by, "k", "time_s").agg(F.array_sort(F.collect_set(F.struct("o", "source"))).alias("s"))
    return found.select(by, "k", "time_s", F.array_join(F.transform("s", lambda x: x["source"]), "+").alias("sources"))


def consecutive(vectors: DataFrame, measure, name: str, by: str = BY) -> DataFrame:
    """measure(previous vec, vec) of each vector but the first."""
    x = vectors.withColumn("__p", F.lag("vec").over(Window.partitionBy(by).orderBy("idx"))).where("__p is not null")
    return x.select(by, "idx", F.round(measure(F.col("__p"), F.col("vec")), 6).alias(name))


def robust_scale(vectors: DataFrame, by: str = BY) -> DataFrame:
    """by, dim, idx, z: each dimension less its median, by the largest of four scales."""
    x = vectors.select(by, "idx", F.posexplode("vec").alias("dim", "x"))
    q = x.groupBy(by, "dim").agg(F.percentile("x", [0.25, 0.5, 0.75]).alias("q"), (F.max("x") - F.min("x")).alias("spread"))
    x = x.join(q, [by, "dim"]).withColumn("d", F.abs(F.col("x") - F.col("q")[1]))
    mad = x.groupBy(by, "dim").agg(F.percentile("d", F.lit(0.5)).alias("mad"))
    scale = F.greatest(1.4826 * F.col("mad"), (F.col("q")[2] - F.col("q")[0]) / 1.349, 0.05 * F.col("spread"), F.lit(1e-9))
    return x.join(mad, [by, "dim"]).select(by, "dim", "idx", ((F.col("x") - F.col("q")[1]) / scale).alias("z"))


def bin_variability(vectors: DataFrame, size: int, by: str = BY) -> DataFrame:
    """by, bin, variability: median distance over all pairs within each bin of `size` vectors (bins have a fixed size)."""
    x = vectors.withColumn("bin", F.floor(F.col("idx") / size).cast("long"))
    y = x.select(F.col(by).alias("__k"), F.col("bin").alias("__bin"), F.col("idx").alias("j"), F.col("vec").alias("w"))
    pairs = x.join(y, (F.col(by) == F.col("__k")) & (F.col("bin") == F.col("__bin")) & (F.col("idx") < F.col("j")))
    return pairs.groupBy(by, "bin").agg(F.percentile(V.rms_distance(F.col("vec"), F.col("w")), F.lit(0.5)).alias("variability"))


def contraction(bins: DataFrame, ks=(1, 2, 3, 5), by: str = BY) -> DataFrame:
    """Mean variability of the first k bins from each stream's middle on, by that of the last k before it."""
    w = Window.partitionBy(by)
    x = bins.withColumn("mid", F.floor(F.count(F.lit(1)).over(w) / 2)).withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("bin")) - 1)
    out = []
    for k in ks:
        post = F.avg(F.when((F.col("n") >= F.col("mid")) & (F.col("n") < F.col("mid") + k), F.col("variability")))
        pre = F.avg(F.when((F.col("n") < F.col("mid")) & (F.col("n") >= F.col("mid") - k), F.col("variability")))
        out.append(F.round(post / F.greatest(pre, F.lit(1e-9)), 6).alias(f"ratio_{k}"))
    return x.groupBy(by).agg(*out)


def block_means(vectors: DataFrame, size: int, by: str = BY) -> DataFrame:
    """by, block, vec: mean vector of each full block."""
    x = vectors.select(by, "idx", F.posexplode("vec").alias("dim", "x")).withColumn("block", F.floor(F.col("idx") / size).cast("long"))
    x = x.groupBy(by, "block", "dim").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n")).where(F.col("n") == size)
    return x.groupBy(by, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vec"))


def regime_ratio(blocks: DataFrame, by: str = BY) -> DataFrame:
    """Change across each block's start, by the mean change within the two blocks on either side; only where all four are there."""
    w = Window.partitionBy(by).orderBy("block")
    x = blocks.withColumn("a", F.lag("vec", 2).over(w)).withColumn("b", F.lag("vec", 1).over(w)).withColumn("d", F.lead("vec", 1).over(w)).where("a is not null and b is not null and d is not null")
    inner = (V.cosine_distance(F.col("a"), F.col("b")) + V.cosine_distance(F.col("vec"), F.col("d"))) / 2
    return x.select(by, "block", F.round(V.cosine_distance(F.col("b"), F.col("vec")) / F.greatest(inner, F.lit(1e-9)), 6).alias("ratio"))


def forward_novelty(vectors: DataFrame, side: int, step: int, by: str = BY) -> DataFrame:
    """Mean over the `side` vectors from each step on of how far they are from the nearest of the `side` before."""
    w = Window.partitionBy(by).orderBy("idx")
    x = vectors.withColumn("pre", F.collect_list("vec").over(w.rowsBetween(-side, -1))).withColumn("post", F.collect_list("vec").over(w.rowsBetween(0, side - 1)))
    x = x.where((F.col("idx") % step == 0) & (F.size("pre") == side) & (F.size("post") == side))
    far = F.transform("post", lambda p: F.array_min(F.transform("pre", lambda q: V.cosine_distance(p, q))))
    return x.select(by, "idx", F.round(V.total(far) / side, 6).alias("novelty"))


def centre(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, center: the median of each number over the blocks(keys, vec)."""
    x = blocks.select(*keys, F.posexplode("vec").alias("dim", "x")).groupBy(*keys, "dim").agg(F.percentile("x", F.lit(0.5)).alias("m"))
    return x.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("center"))


def spread(blocks: DataFrame, centers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, spread: the median distance of blocks to their centre."""
    return blocks.join(centers, keys).groupBy(*keys).agg(F.percentile(V.profile_distance(F.col("vec"), F.col("center")), F.lit(0.5)).alias("spread"))


def sequential(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sequential: the median distance of blocks(keys, idx, vec) that follow one another; 0 for fewer than two."""
    x = blocks.withColumn("__p", F.lag("vec").over(Window.partitionBy(*keys).orderBy("idx")))
    return x.groupBy(*keys).agg(F.coalesce(F.percentile(V.profile_distance(F.col("__p"), F.col("vec")), F.lit(0.5)), F.lit(0.0)).alias("sequential"))


def before_after(blocks: DataFrame, boundaries: DataFrame, side: int, guard: int, by: str = BY) -> DataFrame:
    """boundaries(k, at: a block's number) with between (distance of the centres of `side` blocks before and after, `guard` blocks away) and, of either side, sequential variability and spread. Boundaries without whole sides go."""
    n = [F.col("at") - guard - 1 - i for i in range(side)], [F.col("at") + guard + i for i in range(side)]
    places = F.array(*[F.struct(F.lit(s).alias("side"), i.cast("long").alias("idx")) for s in (0, 1) for i in n[s]])
    x = boundaries.select(by, "k", F.explode(places).alias("p")).select(by, "k", "p.*").join(blocks.select(by, "idx", "vec"), [by, "idx"])
    whole = x.groupBy(by, "k").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") == 2 * side).select(by, "k")
    x, keys = x.join(whole, [by, "k"], "left_semi"), [by, "k", "side"]
    c = centre(x, keys)
    y = c.join(spread(x, c, keys), keys).join(sequential(x, keys), keys)
    one = lambda s, v: F.max(F.when(F.col("side") == s, F.col(v)))
    y = y.groupBy(by, "k").agg(*[one(s, v).alias(f"{name}_{v}") for s, name in ((0, "before"), (1, "after")) for v in ("center", "sequential", "spread")])
    return y.select(by, "k", V.profile_distance(F.col("before_center"), F.col("after_center")).alias("between"), "before_sequential", "after_sequential", "before_spread", "after_spread")


def local_discontinuity(blocks: DataFrame, boundaries: DataFrame, sides: dict[str, int], by: str = BY) -> DataFrame:
    """boundaries(k, at) with the distance of centres on both sides, without a guard, for each named number of blocks; only where all are there."""
    out = boundaries.select(by, "k")
    for name, side in sides.items():
        out = out.join(before_after(blocks, boundaries, side, 0, by).select(by, "k", F.col("between").alias(name)), [by, "k"])
    return out


def context_change(features: DataFrame, times: DataFrame, seconds: float, side: int, guard: int, by: str = BY) -> DataFrame:
    """times(k, time_s) with change: distance of the mean features of `side` frames before and after the nearest frame, `guard` frames away; null out of range."""
    w = Window.partitionBy(by).orderBy("idx")
    before, after = w.rowsBetween(-guard - side, -guard - 1), w.rowsBetween(guard, guard + side - 1)
    scales = {"rms": 1.0, "zcr": 1.0, "mean_abs_delta": 1.0, "crest": 4.0}
    total = sum(F.pow((F.avg(c).over(after) - F.avg(c).over(before)) / s, 2) for c, s in scales.items())
    x = features.withColumn("change", F.when((F.count(F.lit(1)).over(before) == side) & (F.count(F.lit(1)).over(after) == side), F.sqrt(total)))
    x = x.select(by, "idx", (F.col("idx") * seconds).alias("frame_s"), "change")
    return timeline.nearest(times, x, "time_s", "frame_s", by=by).select(*times.columns, F.col("hit.change").alias("change"))


def transition_evidence(base: DataFrame, spectral: DataFrame, temporal: DataFrame | None = None, local: DataFrame | None = None, keys: tuple[str, ...] = (BY, "k")) -> DataFrame:
    """One record for each of base(keys): measurements joined where they were made, ratios given in base before those derived, and the label UNRESOLVED, which no policy changes yet."""
    out = base.join(spectral, list(keys), "left")
    for other in (temporal, local):
        if other is not None:
            given = [c for c in other.columns if c in base.columns and c not in keys]
            out = out.join(other.withColumnsRenamed({c: f"__{c}" for c in given}), list(keys), "left")
            out = out.withColumns({c: F.coalesce(c, f"__{c}") for c in given}).drop(*[f"__{c}" for c in given])
    return out.withColumn("label", F.lit("UNRESOLVED"))


def as_record(columns: list[str]) -> Column:
    """A flat JSON record of columns, keys sorted; nulls stay as null."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def multisignal(references: DataFrame, basins: DataFrame, series: DataFrame, horizons: DataFrame, regime: DataFrame, novelty: DataFrame, by: str = BY) -> DataFrame:
    """Candidates of each reference(k): the union of basins and maxima, with change at four horizons (time_s, d250, d500, d1, d2), the geometric mean of regime ratios (time_s, ratios) and forward novelty (time_s, novelty), ranked by family and, of each reference, the one that minimax selects (selected)."""
    ms = lambda df: df.withColumn("time_s", F.bround("time_s", 3))
    x = union_candidates(references, basins, series, by=by)
    x = x.join(ms(horizons), [by, "time_s"]).join(ms(regime).select(by, "time_s", V.geomean(F.col("ratios")).alias("mfcc_geo")), [by, "time_s"]).join(ms(novelty).select(by, "time_s", F.col("novelty").alias("forward_novelty")), [by, "time_s"])
    x = x.withColumn("__s", F.struct(by, "k"))
    ranked = family_rrf(x, "__s")
    best = minimax(ranked, "__s").select("__s", F.col("time_s").alias("__t"))
    return ranked.join(best, "__s").withColumn("selected", F.col("time_s") == F.col("__t")).drop("__s", "__t")
