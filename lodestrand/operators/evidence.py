"""Evidence around references: clusters of proposals, regions between supported edges, fade associations, floors, confidence.

A hypothesis has hyp_id, time_s, n_basin, n_structural (its proposals by source), depth, novelty (strongest structural), and
the geometry of its first basin (start_s, minimum_s, recovery_s; null without), and peak_s and last_peak_s (the times of its
strongest and its last structural proposal). Ids stand for identity: equal values are still two hypotheses.
"""

from __future__ import annotations

import statistics

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import timeline
from .detect import fold

BY = "stream_id"
RADIUS = 3.0
#: How far from a reference evidence is looked for, in seconds.
REACH = 24.0
HYPOTHESIS = "hyp_id long, time_s double, n_basin int, n_structural int, depth double, novelty double, start_s double, minimum_s double, recovery_s double, peak_s double, last_peak_s double"


def clusters(proposals: DataFrame, radius: float = RADIUS, by: str = BY) -> DataFrame:
    """Hypotheses of proposals(time_s, source, depth, strength, start_s, recovery_s): a cluster holds what is within radius of its first."""

    def step(pdf):
        pdf = pdf.sort_values(["time_s", "source"], ignore_index=True)
        groups, first = [], None
        for row in pdf.itertuples(index=False):
            if first is None or row.time_s - first > radius:
                groups.append([])
                first = row.time_s
            groups[-1].append(row)
        out = []
        for i, g in enumerate(groups):
            basins = [r for r in g if r.source == "BASIN"]
            peaks = [r.strength for r in g if r.source == "STRUCTURAL"]
            geometry = (basins[0].start_s, basins[0].time_s, basins[0].recovery_s) if basins else (None, None, None)
            loud = max((r for r in g if r.source == "STRUCTURAL"), key=lambda r: (r.strength, r.time_s), default=None)
            last = max((r.time_s for r in g if r.source == "STRUCTURAL"), default=None)
            out.append((i, statistics.median(r.time_s for r in g), len(basins), len(peaks), min((r.depth for r in basins), default=None), max(peaks, default=None), *geometry, loud.time_s if loud else None, last))
        return out

    return fold(proposals, HYPOTHESIS, step, by, "time_s")


def supported(h: str = "") -> Column:
    """Both sources, and a basin with edges."""
    c = lambda n: F.col(f"{h}{n}")
    return (c("n_basin") > 0) & (c("n_structural") > 0) & c("start_s").isNotNull()


def complementary(h: str = "") -> Column:
    """Structural alone, or basin alone with edges."""
    c = lambda n: F.col(f"{h}{n}")
    return ((c("n_structural") > 0) & (c("n_basin") == 0)) | ((c("n_basin") > 0) & (c("n_structural") == 0) & c("start_s").isNotNull())


def confidence(hypotheses: DataFrame, between: Column, deepest: float = 0.06, novel: float = 0.35, apart: float = 0.15) -> DataFrame:
    """confidence HIGH for deep basins with a strong structural peak and different sides; else UNRESOLVED."""
    high = (F.col("n_basin") > 0) & (F.col("n_structural") > 0) & (F.col("depth") <= deepest) & (F.col("novelty") >= novel) & (between >= apart)
    return hypotheses.withColumn("confidence", F.when(F.coalesce(high, F.lit(False)), "HIGH").otherwise("UNRESOLVED"))


def around(references: DataFrame, hypotheses: DataFrame, reach: float = REACH, by: str = BY) -> DataFrame:
    """references(k, reference_s), each with the array `hyps` of hypotheses within reach, by time. A window holds few."""
    h = hypotheses.select(by, F.col("time_s").alias("__t"), F.struct("time_s", *[c for c in hypotheses.columns if c not in (by, "time_s")]).alias("h"))
    found = timeline.near(references, h, "reference_s", "__t", reach, by).groupBy(*references.columns).agg(F.array_sort(F.collect_list("h")).alias("hyps"))
    kind = found.schema["hyps"].dataType.simpleString()
    return references.join(found, references.columns, "left").withColumn("hyps", F.coalesce("hyps", F.array().cast(kind)))


IS_SUPPORTED = "({h}.n_basin > 0 and {h}.n_structural > 0 and {h}.start_s is not null)"
IS_COMPLEMENTARY = "(({h}.n_structural > 0 and {h}.n_basin = 0) or ({h}.n_basin > 0 and {h}.n_structural = 0 and {h}.start_s is not null))"


def symmetric_regions(contexts: DataFrame) -> DataFrame:
    """contexts(reference_s, hyps) with `regions`: neighbouring supported hypotheses to which the reference relates, and what lies between."""
    inside = "reference_s between {e}.start_s and {e}.recovery_s"
    return (
        contexts.withColumn("edges", F.expr(f"filter(hyps, h -> {IS_SUPPORTED.format(h='h')})"))
        .withColumn("pairs", F.expr("transform(slice(edges, 1, greatest(size(edges) - 1, 0)), (l, i) -> struct(l as l, get(edges, i + 1) as r))"))
        .withColumn("related", F.expr(f"filter(pairs, p -> reference_s between p.l.time_s and p.r.time_s or {inside.format(e='p.l')} or {inside.format(e='p.r')})"))
        .withColumn("regions", F.expr("transform(related, p -> struct(p.l as l, p.r as r, filter(hyps, h -> h.time_s > p.l.time_s and h.time_s < p.r.time_s) as interior))"))
        .drop("edges", "pairs", "related")
    )


def asymmetric_regions(contexts: DataFrame) -> DataFrame:
    """contexts with `one_sided`: supported hypotheses before the reference and the first complementary one after it, nearer than they, with none supported between."""
    return (
        contexts.withColumn("after", F.expr(f"get(filter(hyps, h -> h.time_s > reference_s and {IS_COMPLEMENTARY.format(h='h')}), 0)"))
        .withColumn("before", F.expr(f"filter(hyps, h -> h.time_s < reference_s and {IS_SUPPORTED.format(h='h')})"))
        .withColumn("wide", F.expr("transform(before, p -> struct(p as primary, after as complementary, filter(hyps, h -> h.time_s > p.time_s and h.time_s < after.time_s) as interior))"))
        .withColumn("one_sided", F.expr(f"filter(wide, x -> after is not null and not exists(x.interior, h -> {IS_SUPPORTED.format(h='h')}) and after.time_s - reference_s < reference_s - x.primary.time_s)"))
        .drop("after", "before", "wide")
    )


def outgoing_association(contexts: DataFrame, fades: DataFrame, by: str = BY) -> DataFrame:
    """by, k, out: of outgoing fades that start by the reference and its hypotheses, the closest pair."""
    f = fades.select(by, F.col("floor_s").alias("__t"), F.struct("start_idx", "start_s", "floor_s", "floor_rms", "rise_s", "descent_ratio", "descent_consistency").alias("f"))
    x = timeline.near(contexts, f, "reference_s", "__t", REACH, by).where("f.start_s <= reference_s")
    x = x.select(by, "k", "f", F.explode("hyps").alias("h"))
    gap = F.abs(F.col("f.floor_s") - F.col("h.time_s"))
    order = F.struct(gap, -F.col("f.descent_consistency"), -F.col("f.descent_ratio"), -F.col("f.floor_s"), F.col("f.start_idx"), F.col("h.hyp_id"))
    return x.groupBy(by, "k").agg(F.min_by(F.struct("f", "h", gap.alias("distance_s")), order).alias("out"))


def incoming_association(contexts: DataFrame, fades: DataFrame, by: str = BY) -> DataFrame:
    """by, k, inc: of incoming fades established from the reference on, each with its closest hypothesis from its start on, the closest pair."""
    f = fades.select(by, F.col("established_s").alias("__t"), F.struct("start_idx", "start_s", "established_s", "ascent_ratio", "ascent_consistency", "persistence_ratio").alias("f"))
    x = timeline.near(contexts, f, "reference_s", "__t", REACH, by).where("f.established_s >= reference_s")
    x = x.withColumn("anchor", F.when(F.col("f.start_s") >= F.col("reference_s"), F.col("f.start_s")).otherwise(F.col("f.established_s")))
    x = x.select(by, "k", "reference_s", "f", "anchor", F.explode("hyps").alias("h")).where("h.time_s >= f.start_s")
    gap = F.abs(F.col("anchor") - F.col("h.time_s"))
    own = x.groupBy(by, "k", "reference_s", "f", "anchor").agg(F.min_by(F.struct("h", gap.alias("distance_s")), F.struct(gap, "h.time_s", "h.hyp_id")).alias("b"))
    order = F.struct("b.distance_s", F.abs(F.col("anchor") - F.col("reference_s")), -F.col("f.ascent_consistency"), -F.col("f.ascent_ratio"), -F.col("f.persistence_ratio"), "anchor", "f.start_idx")
    return own.groupBy(by, "k").agg(F.min_by(F.struct("f", "b.h", "b.distance_s"), order).alias("inc"))


def fade_floor(contexts: DataFrame, fades: DataFrame, by: str = BY) -> DataFrame:
    """by, k, floor_s, handoff_id: the deepest floor, if it is the only one so deep, has no rise and lies by the reference, with the only supported basin around it; else, if later fades start by the reference, the floor alone."""
    f = fades.select(by, F.col("floor_s").alias("__t"), F.struct("start_s", "floor_s", "floor_rms", "rise_s", "start_idx").alias("f"))
    x = timeline.near(contexts, f, "reference_s", "__t", REACH, by)
    x = x.groupBy(by, "k", "reference_s", "hyps").agg(F.collect_list("f").alias("fades"))
    x = x.withColumn("deepest", F.expr("filter(fades, f -> f.floor_rms = array_min(transform(fades, g -> g.floor_rms)))")).where("size(deepest) = 1").withColumn("d", F.get("deepest", F.lit(0)))
    x = x.where("d.rise_s is null and d.floor_s <= reference_s")
    x = x.withColumn("owners", F.expr(f"filter(hyps, h -> {IS_SUPPORTED.format(h='h')} and h.time_s >= d.floor_s and d.floor_s between h.start_s and h.recovery_s)"))
    x = x.withColumn("later", F.expr("exists(fades, f -> f.start_s > d.floor_s and f.start_s <= reference_s)"))
    return x.where("size(owners) = 1 or later").select(by, "k", F.col("d.floor_s").alias("floor_s"), F.col("d.start_idx").alias("floor_fade"), F.expr("if(size(owners) = 1, get(owners, 0).hyp_id, null)").alias("handoff_id"))


OUTGOING = ("start_idx", "start_s", "floor_s", "start_rms", "floor_rms", "rise_s", "descent_ratio", "descent_consistency")
INCOMING = ("start_idx", "start_s", "established_s", "ascent_ratio", "ascent_consistency", "persistence_ratio")


def with_fades(contexts: DataFrame, outgoing: DataFrame, incoming: DataFrame, pairs: DataFrame, by: str = BY) -> DataFrame:
    """contexts with the arrays outs, ins and geometries: fades whose floor, or establishment, is within REACH of the reference, by their start, and the pairs of those falls."""
    def gathered(rows: DataFrame, at: str, fields: tuple[str, ...], name: str) -> DataFrame:
        own = rows.select(by, F.col(at).alias("__t"), F.struct(*fields).alias("__f"))
        found = timeline.near(contexts.select(by, "k", "reference_s"), own, "reference_s", "__t", REACH, by).groupBy(by, "k").agg(F.array_sort(F.collect_list("__f")).alias(name))
        return found

    geometry = gathered(pairs, "floor_s", ("start_idx", "floor_s", "incoming_start_s", "incoming_established_s"), "geometries")
    x = contexts
    for found in (gathered(outgoing, "floor_s", OUTGOING, "outs"), gathered(incoming, "established_s", INCOMING, "ins"), geometry):
        name = found.columns[-1]
        kind = found.schema[name].dataType.simpleString()
        x = x.join(found, [by, "k"], "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return x


def first_id(column: str, order: str = "time_s", by: str = BY) -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(order)).alias(column)
