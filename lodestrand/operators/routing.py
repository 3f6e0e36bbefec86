"""Which specialist owns a transition, and the geometry that the specialists choose. Priorities are CASE chains over evidence columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evidence as V

BY = "stream_id"


def insert_flags(contexts: DataFrame) -> DataFrame:
    """contexts(reference_s, hyps, regions, one_sided, geometries) with symmetric_insert and asymmetric_insert.

    Symmetric: exactly one region, no interior of both single sources, no handoff shared with the left basin, and the
    reference between edges of which none (or, with one structural interior, only the right) is the strongest peak.
    """
    peak = "array_max(transform(hyps, h -> h.novelty))"
    structural, basin = "(h.n_structural > 0 and h.n_basin = 0)", "(h.n_basin > 0 and h.n_structural = 0)"
    r = "get(regions, 0)"
    shared = f"(reference_s between {r}.l.start_s and {r}.l.recovery_s and exists(coalesce(geometries, array()), g -> g.floor_s = g.incoming_start_s and reference_s <= g.floor_s and g.floor_s between {r}.l.start_s and {r}.l.recovery_s and g.floor_s < {r}.r.time_s))"
    between = f"reference_s between {r}.l.time_s and {r}.r.time_s"
    left, right = f"coalesce({r}.l.novelty = {peak}, false)", f"coalesce({r}.r.novelty = {peak}, false)"
    mixed = f"(exists({r}.interior, h -> {structural}) and exists({r}.interior, h -> {basin}))"
    single = f"(size({r}.interior) = 1 and exists({r}.interior, h -> {structural}))"
    symmetric = f"size(regions) = 1 and not {mixed} and not {shared} and {between} and not {left} and (not {right} or {single})"
    asymmetric = f"size(one_sided) = 1 and coalesce(get(one_sided, 0).primary.novelty = {peak}, false)"
    return contexts.withColumn("symmetric_insert", F.coalesce(F.expr(symmetric), F.lit(False))).withColumn("asymmetric_insert", F.coalesce(F.expr(asymmetric), F.lit(False)))


def routed(c: DataFrame) -> DataFrame:
    """kind by priority. Columns: symmetric_insert, asymmetric_insert, island_region, island, floor_handoff, floor_only, rise, n_basins, stale, n_reconciled, absorbed, two_sided, n_handoffs, local_complete, shared_handoff."""
    fade_like = F.col("rise") & (F.col("n_basins") > 0) & ~F.col("stale")
    interstitial_like = F.col("n_handoffs") >= 2
    conflict = F.when((F.col("n_reconciled") != 1) | F.col("absorbed"), "INTERSTITIAL").when(F.col("two_sided"), "FADE").otherwise("INTERSTITIAL")
    kind = (
        F.when(F.col("symmetric_insert") | F.col("asymmetric_insert"), "BOUNDED_INSERT")
        .when(F.col("island_region"), "INTERSTITIAL")
        .when(F.col("floor_handoff"), "FADE")
        .when(F.col("island"), "INTERSTITIAL")
        .when(fade_like & interstitial_like, conflict)
        .when(fade_like, "FADE")
        .when(interstitial_like, "INTERSTITIAL")
        .when(F.col("floor_only"), "FADE")
        .when(F.col("local_complete") & ~F.col("rise") & F.col("shared_handoff"), "HARD_CUT")
        .otherwise("AMBIGUOUS")
    )
    return c.withColumn("kind", kind)


def hard_cut_boundary(contexts: DataFrame, selected: str = "selected_s") -> DataFrame:
    """contexts(reference_s, hyps) with boundary_s: by the selected time's basin, else the reference's, else the one basin between, else as it is."""
    containing = "filter(hyps, h -> h.start_s is not null and {t} between h.start_s and h.recovery_s)"
    nearest = "get(array_sort(transform({a}, h -> struct(abs(h.minimum_s - {t}) as d, h.minimum_s as m, h as h))), 0).h"
    x = contexts.withColumn("__s", F.expr(nearest.format(a=containing.format(t=selected), t=selected))).withColumn("__r", F.expr(nearest.format(a=containing.format(t="reference_s"), t="reference_s")))
    x = x.withColumn("__e", F.expr(f"filter(hyps, h -> h.start_s is not null and {selected} < h.start_s and h.recovery_s < reference_s)"))
    x = x.withColumn("__n", F.expr("get(array_sort(transform(hyps, h -> struct(abs(h.time_s - reference_s) as d, h.time_s as t))), 0).t"))
    boundary = F.expr(f"""case
      when __s is not null then case
        when {selected} >= __s.minimum_s then __s.recovery_s
        when __s.n_structural > 0 and reference_s >= __s.recovery_s then __s.recovery_s
        when __s.n_basin > 0 and __s.n_structural = 0 and reference_s between __s.start_s and __s.minimum_s then reference_s
        when reference_s between __s.start_s and __s.minimum_s then __s.minimum_s
        else {selected} end
      when __r is not null then case
        when reference_s > __r.minimum_s then __r.recovery_s
        when __r.n_basin > 0 and __r.n_structural = 0 then reference_s
        else __r.minimum_s end
      when size(__e) = 1 then get(__e, 0).recovery_s
      when exists(hyps, h -> h.start_s is not null) then {selected}
      else coalesce(__n, {selected}) end""")
    return x.withColumn("boundary_s", boundary).drop("__s", "__r", "__e", "__n")


def multisignal_decision(selected: Column, reference: Column, rise: Column) -> Column:
    """struct(kind, incoming_start_s, outgoing_end_s): a cut without a rise or with one too far out, nothing past it, else a crossfade."""
    cut = F.struct(F.lit("HARD_CUT").alias("kind"), selected.alias("incoming_start_s"), selected.alias("outgoing_end_s"))
    fade = F.struct(F.lit("CROSSFADE").alias("kind"), selected.alias("incoming_start_s"), rise.alias("outgoing_end_s"))
    lead = reference - selected
    return F.when(rise.isNull(), cut).when(selected >= rise, F.lit(None)).when((lead >= 0) & (rise - reference > lead), cut).otherwise(fade)


def incoming_discovery(contexts: DataFrame, outgoing: str = "outgoing_end_s") -> DataFrame:
    """contexts(hyps with confidence) with discovered_s: the earliest HIGH hypothesis after the outgoing edge (its recovery, if it precedes its minimum), else the earliest of two or more recoveries after it."""
    high = f"transform(filter(hyps, h -> h.confidence = 'HIGH' and h.time_s > {outgoing}), h -> if(h.minimum_s is not null and h.time_s < h.minimum_s, h.recovery_s, h.time_s))"
    recoveries = f"transform(filter(hyps, h -> {V.IS_SUPPORTED.format(h='h')} and h.recovery_s > {outgoing}), h -> h.recovery_s)"
    return contexts.withColumn("discovered_s", F.expr(f"coalesce(array_min({high}), if(size({recoveries}) >= 2, array_min({recoveries}), null))"))


def incoming_refined(kind: Column, incoming: Column, outgoing: Column, discovered: Column) -> Column:
    """A HARD_CUT with a later incoming edge becomes an EXCLUSION."""
    later = (kind == "HARD_CUT") & (discovered > outgoing)
    return F.when(later, F.struct(F.lit("EXCLUSION").alias("kind"), discovered.alias("incoming_start_s"), outgoing.alias("outgoing_end_s"))).otherwise(F.struct(kind.alias("kind"), incoming.alias("incoming_start_s"), outgoing.alias("outgoing_end_s")))
