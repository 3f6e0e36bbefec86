"""Queries over hypotheses, regions, associations and routes, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrand.operators import candidates as C
from lodestrand.operators import detect as D
from lodestrand.operators import evidence as V
from lodestrand.operators import islands as I
from lodestrand.operators import hybrid as H
from lodestrand.operators import output as O
from lodestrand.operators import roles as R_
from lodestrand.operators import routing as R
from lodestrand.operators import specialists as P
from lodestrand.operators import timeline as T
from lodestrand.shared import checkpoint
from lodestrand.sources import bindings as B

from .fade_sql import INCOMING, OUTGOING, PAIRS
from .detector_queries import NOVELTY_SQL, _features, _outgoing, _round
from .detector_queries import SQL as DETECTOR_SQL
from .timeline_queries import FIXED_SQL, MINIMA_SQL, _ends, _fixed

QUIET = 0.3


def _proposals(spark, sf):
    """Basins at quiet local minima, structure at novelty peaks."""
    levels = B.levels(spark, sf)
    overall = levels.groupBy("stream_id").agg(F.percentile("rms", F.lit(0.5)).alias("overall"))
    m = C.local_minima(levels).join(overall, "stream_id").where(F.col("rms") <= QUIET * F.col("overall"))
    basins = m.select("stream_id", F.col("minimum_s").alias("time_s"), F.lit("BASIN").alias("source"), F.round(F.col("rms") / F.greatest("overall", F.lit(1e-12)), 6).alias("depth"), F.lit(None).cast("double").alias("strength"), (F.col("minimum_s") - 0.5).alias("start_s"), (F.col("minimum_s") + 0.75).alias("recovery_s"))
    w = Window.partitionBy("stream_id").orderBy("idx")
    n = _round(D.novelty(_features(spark, sf), 3), "novelty").withColumn("b", F.lag("novelty").over(w)).withColumn("a", F.lead("novelty").over(w))
    n = n.where("novelty >= 0.04D and (b is null or novelty >= b) and (a is null or novelty >= a)")
    null = F.lit(None).cast("double")
    return basins.unionByName(n.select("stream_id", (F.col("idx") * 0.5).alias("time_s"), F.lit("STRUCTURAL").alias("source"), null.alias("depth"), F.least(F.lit(1.0), "novelty").alias("strength"), null.alias("start_s"), null.alias("recovery_s")))


def _hypotheses(spark, sf):
    return V.clusters(_proposals(spark, sf))


def _contexts(spark, sf, interval=None):
    fixed = C.fixed(_ends(spark, sf), interval) if interval else _fixed(spark, sf)
    return V.around(fixed.select("stream_id", "k", F.col("candidate_s").alias("reference_s")), _hypotheses(spark, sf))


def q30_cluster(spark, sf):
    return _hypotheses(spark, sf).drop("peak_s", "last_peak_s")


def q31_confidence(spark, sf):
    between = F.col("novelty") - F.col("depth")
    return V.confidence(_hypotheses(spark, sf), between).select("stream_id", "hyp_id", "time_s", "confidence")


def q57_symmetric_regions(spark, sf):
    x = V.symmetric_regions(_contexts(spark, sf, 2.5)).select("stream_id", "k", F.explode("regions").alias("r"))
    return x.select("stream_id", "k", F.col("r.l.hyp_id").alias("left_id"), F.col("r.r.hyp_id").alias("right_id"), F.size("r.interior").alias("n_interior"))


def q58_asymmetric_regions(spark, sf):
    x = V.asymmetric_regions(_contexts(spark, sf)).select("stream_id", "k", F.explode("one_sided").alias("r"))
    return x.select("stream_id", "k", F.col("r.primary.hyp_id").alias("primary_id"), F.col("r.complementary.hyp_id").alias("complementary_id"), F.size("r.interior").alias("n_interior"))


def _associations(spark, sf, contexts):
    out = V.outgoing_association(contexts, _outgoing(spark, sf))
    inc = V.incoming_association(contexts, D.incoming_fades(B.levels(spark, sf)))
    return out.join(inc, ["stream_id", "k"], "full_outer")


def q59_fade_association(spark, sf):
    x = _associations(spark, sf, _contexts(spark, sf))
    return x.select(
        "stream_id", "k", F.col("out.f.floor_s").alias("outgoing_floor_s"), F.col("out.h.hyp_id").alias("outgoing_id"), F.col("out.distance_s").alias("outgoing_distance_s"), F.col("inc.f.start_s").alias("incoming_start_s"), F.col("inc.h.hyp_id").alias("incoming_id"), F.col("inc.distance_s").alias("incoming_distance_s")
    )


def _evidence(spark, sf, interval=None):
    """Contexts with regions, fades, island, insert flags, associations, floor, rise, lead basins and what the route asks of them."""
    levels = checkpoint(B.levels(spark, sf))
    rises, basins = checkpoint(D.energy_rises(levels)), checkpoint(D.quiet_basins(levels))
    outgoing, incoming = checkpoint(D.with_rise(D.outgoing_fades(levels), rises)), checkpoint(D.incoming_fades(levels))
    bare = checkpoint(_contexts(spark, sf, interval))
    contexts = checkpoint(V.with_fades(bare, outgoing, incoming, D.fade_pairs(outgoing, incoming)))
    x = checkpoint(R.insert_flags(V.asymmetric_regions(V.symmetric_regions(contexts))))
    x = checkpoint(I.with_island(x))
    associated = V.outgoing_association(bare, outgoing).join(V.incoming_association(bare, incoming), ["stream_id", "k"], "full_outer")
    x = x.join(associated, ["stream_id", "k"], "left").join(V.fade_floor(contexts, outgoing), ["stream_id", "k"], "left")
    references = contexts.select("stream_id", "k", "reference_s")
    late = H.crossfade_rise(references, rises, ["stream_id", "k", "reference_s"]).select("stream_id", "k", F.col("rise_s").alias("rise_at"))
    lead = T.near(references, basins.select("stream_id", "center_s"), "reference_s", "center_s", 2.5).where((F.col("reference_s") - F.col("center_s")) >= 0.5).groupBy("stream_id", "k").agg(F.count(F.lit(1)).alias("n_lead"))
    x = x.join(late, ["stream_id", "k"], "left").join(lead, ["stream_id", "k"], "left")
    same = "filter(geometries, g -> g.start_idx = out.f.start_idx {more})"
    stale = f"out is not null and inc is null and size({same.format(more='')}) > 0 and forall({same.format(more='')}, g -> g.incoming_established_s < reference_s)"
    x = checkpoint(x)  # it is read by expression after expression
    return (
        x.withColumn("island_region", F.expr("coalesce(island.region is not null, false)")).withColumn("absorbed", F.expr(I.absorbed()))
        .withColumn("floor_handoff", F.col("handoff_id").isNotNull()).withColumn("floor_only", F.col("floor_s").isNotNull() & F.col("handoff_id").isNull())
        .withColumn("rise", F.col("rise_at").isNotNull()).withColumn("n_basins", F.coalesce("n_lead", F.lit(0)))
        .withColumn("stale", F.coalesce(F.expr(stale), F.lit(False))).withColumn("n_reconciled", F.coalesce(F.expr(f"size({same.format(more='and g.incoming_start_s = inc.f.start_s')})"), F.lit(0)))
        .withColumn("two_sided", F.col("out").isNotNull() & F.col("inc").isNotNull())
        .withColumn("n_handoffs", F.expr(f"size(filter(hyps, h -> {V.IS_SUPPORTED.format(h='h')}))"))
        .withColumn("local_complete", F.expr("exists(hyps, h -> abs(h.time_s - reference_s) <= 2)"))
        .withColumn("shared_handoff", F.coalesce(F.expr(R_.hard_cut()).isNotNull(), F.lit(False)))
    )


def _routed(spark, sf, interval=None):
    x = _evidence(spark, sf, interval)
    return R.routed(x.withColumn("__i", F.col("island")).withColumn("island", F.col("__i").isNotNull())).withColumn("island", F.col("__i")).drop("__i")


def q60_route(spark, sf):
    return _routed(spark, sf).select("stream_id", "k", "reference_s", "symmetric_insert", "asymmetric_insert", "island_region", F.col("island").isNotNull().alias("island"), "floor_handoff", "rise", "n_handoffs", "kind")


def q80_acoustic_island(spark, sf):
    x = _evidence(spark, sf, 2.5).where("island is not null")
    return x.select("stream_id", "k", F.col("island.handoff.hyp_id").alias("handoff_id"), F.col("island.decay.start_idx").alias("decay_idx"), F.col("island.reset.start_idx").alias("reset_idx"), F.col("island_region").alias("has_region"))


def q81_transition_roles(spark, sf):
    """Roles of each routed transition, by its kind, and which insert owns it."""
    x = _routed(spark, sf, 2.5)
    x = checkpoint(R_.insert(checkpoint(R_.interstitial(checkpoint(x), "a")), "b"))
    roles = F.expr(f"case kind when 'BOUNDED_INSERT' then b when 'INTERSTITIAL' then coalesce({R_.island()}, a) when 'FADE' then {R_.floor()} when 'HARD_CUT' then {R_.hard_cut()} end")
    return x.withColumn("r", roles).select("stream_id", "k", "kind", F.expr(R_.provenance()).alias("insert_by"), "r.*")


def q82_fade_geometry(spark, sf):
    x = _evidence(spark, sf).withColumn("selected_s", F.col("reference_s") - 1.25).withColumn("d", F.expr(P.fade_geometry()))
    return x.where("d is not null").select("stream_id", "k", "reference_s", "d.*")


def q83_specialists(spark, sf):
    """The decision of the specialist that each context is routed to, and what refined it."""
    x = _routed(spark, sf, 2.5).withColumn("selected_s", F.col("reference_s") - 0.75)
    x = checkpoint(R.hard_cut_boundary(checkpoint(P.insert_geometry(checkpoint(x), F.col("rise")))))
    x = x.withColumn("fade", F.expr(P.fade_geometry())).withColumn("boundary_s", F.coalesce(F.expr(P.terminal_handoff()), "boundary_s")).withColumn("cut", F.expr(P.CUT.format(t="boundary_s")))
    x = checkpoint(P.interstitial_geometry(checkpoint(R_.interstitial(checkpoint(x))), "selected_s"))
    x = x.withColumn("interstitial", F.expr(P.conservative("interstitial")))
    return P.dispatched(x).where("decision is not null").select("stream_id", "k", "reference_s", F.col("kind").alias("route"), "decision.*")


def q107_routing_trace(spark, sf):
    """Each routing observation as a line of JSON, read again."""
    names = ["symmetric_insert", "asymmetric_insert", "kind", "n_handoffs", "rise_at"]
    lines = O.trace(_routed(spark, sf).select("stream_id", "k", *names))
    fields = F.from_json("record", "kind string, n_handoffs int, rise_at double, symmetric_insert boolean")
    return lines.select("stream_id", "k", fields.alias("r")).select("stream_id", "k", "r.*")


def q61_specialist_geometry(spark, sf):
    x = _contexts(spark, sf).withColumn("selected_s", F.col("reference_s") - 1.25)
    return R.hard_cut_boundary(x).select("stream_id", "k", "reference_s", "selected_s", "boundary_s")


def q78_insert_geometry(spark, sf):
    x = V.asymmetric_regions(V.symmetric_regions(_contexts(spark, sf, 2.5)))
    return P.unpacked(P.insert_geometry(x, F.lit(False)), "insert")


def q79_supported_exclusion(spark, sf):
    x = _contexts(spark, sf, 2.5).withColumn("selected_s", F.col("reference_s") - 0.25)
    return P.unpacked(P.supported_exclusion(x, "selected_s"), "exclusion")


QUERIES = {f.__name__: f for f in (q30_cluster, q31_confidence, q57_symmetric_regions, q58_asymmetric_regions, q59_fade_association, q60_route, q61_specialist_geometry, q107_routing_trace, q80_acoustic_island, q81_transition_roles, q82_fade_geometry, q83_specialists, q78_insert_geometry, q79_supported_exclusion)}

PROPOSALS_SQL = NOVELTY_SQL + ", " + MINIMA_SQL + """, ov as (select stream_id, median(rms) as overall from lv group by stream_id),
pp as (select mi.stream_id, minimum_s as time_s, 'BASIN' as source, round(rms / greatest(overall, 1e-12), 6) as depth, null::double as strength, minimum_s - 0.5::double as start_s, minimum_s + 0.75::double as recovery_s from mi join ov using (stream_id) where rms <= 0.3::double * overall
  union all select stream_id, idx * 0.5::double, 'STRUCTURAL', null, least(1, novelty), null, null from (select *, lag(novelty) over w as b, lead(novelty) over w as a from no window w as (partition by stream_id order by idx))
  where novelty >= 0.04::double and (b is null or novelty >= b) and (a is null or novelty >= a)),
pn as (select *, row_number() over (partition by stream_id order by time_s, source) as n from pp),
wk as (select stream_id, n, time_s as anchor, 0::bigint as hyp_id from pn where n = 1
  union all select p.stream_id, p.n, case when p.time_s - w.anchor > 3 then p.time_s else w.anchor end, w.hyp_id + case when p.time_s - w.anchor > 3 then 1 else 0 end from wk w join pn p on p.stream_id = w.stream_id and p.n = w.n + 1),
hy as (select stream_id, hyp_id, median(time_s) as time_s, cast(count(*) filter (where source = 'BASIN') as int) as n_basin, cast(count(*) filter (where source = 'STRUCTURAL') as int) as n_structural, min(depth) as depth, max(strength) as novelty,
  arg_min(start_s, n) filter (where source = 'BASIN') as start_s, arg_min(time_s, n) filter (where source = 'BASIN') as minimum_s, arg_min(recovery_s, n) filter (where source = 'BASIN') as recovery_s from pn join wk using (stream_id, n) group by stream_id, hyp_id),
sf as (select *, n_basin > 0 and n_structural > 0 as sup, (n_basin > 0) <> (n_structural > 0) as comp from hy)"""
FADES_SQL = OUTGOING + ", " + INCOMING + """, ao as (select stream_id, k, p.* from (select c.stream_id, c.k, arg_min({'floor': f.floor_s, 'f': f.start_idx, 'h': c.hyp_id, 'd': abs(f.floor_s - c.time_s)},
    row(abs(f.floor_s - c.time_s), -f.descent_consistency, -f.descent_ratio, -f.floor_s, f.start_idx, c.hyp_id)) as p from cx c join og f on f.stream_id = c.stream_id and f.start_s <= c.ref and abs(f.floor_s - c.ref) <= 24 group by c.stream_id, c.k)),
  ax as (select c.*, f.start_idx as fi, f.start_s as fs, f.ascent_consistency as fc, f.ascent_ratio as fr, f.persistence_ratio as fq, case when f.start_s >= c.ref then f.start_s else f.established_s end as anchor
    from cx c join ig f on f.stream_id = c.stream_id and f.established_s >= c.ref and f.established_s - c.ref <= 24 and c.time_s >= f.start_s),
  ay as (select stream_id, k, ref, fi, fs, fc, fr, fq, anchor, arg_min({'h': hyp_id, 'd': abs(anchor - time_s)}, row(abs(anchor - time_s), time_s, hyp_id)) as b from ax group by all),
  ai as (select stream_id, k, p.* from (select stream_id, k, arg_min({'start': fs, 'f': fi, 'h': b.h, 'd': b.d}, row(b.d, abs(anchor - ref), -fc, -fr, -fq, anchor, fi)) as p from ay group by stream_id, k))"""
#: Quiet basins over the levels, without the bindings.
BASINS_SQL_OF_LEVELS = (
    DETECTOR_SQL["q20_quiet_basin"][DETECTOR_SQL["q20_quiet_basin"].index("x as (select *, lag(rms)") :].split("\n        select stream_id, l as left_idx")[0].replace("x as (", "qx as (", 1).replace("from x where", "from qx where").replace("m as (", "qm as (", 1).replace("from m)", "from qm)").replace("select m.*", "select qm.*").replace("v.stream_id = m.stream_id", "v.stream_id = qm.stream_id").replace("v.idx < m.idx", "v.idx < qm.idx").replace("v.idx > m.idx", "v.idx > qm.idx").replace("v.rms > m.rms", "v.rms > qm.rms").replace("e as (", "qe as (", 1)
    + ", qb as (select stream_id, (l + r + 1) * 0.25::double as c from (select *, row_number() over (partition by stream_id, l, r order by rms, idx) as n from qe where (r - l + 1) * 0.5 <= 1.5) where n = 1)"
)
#: What a context's row holds, as tables: fades near references, regions, the insert flags, islands, floors, rises and lead basins.
EVIDENCE_SQL = (
    FADES_SQL + ", " + PAIRS + """,
  rf as (select distinct stream_id, k, candidate_s as ref from ca),
  co as (select rf.k, rf.ref, f.* from rf join og f on f.stream_id = rf.stream_id and abs(f.floor_s - rf.ref) <= 24),
  cz as (select rf.k, rf.ref, f.*, least(f.ascent_ratio, f.persistence_ratio) as strength, (select count(*) from cx c where c.stream_id = rf.stream_id and c.k = rf.k and c.sup and f.start_s between c.start_s and c.recovery_s) = 1 as owned
    from rf join ig f on f.stream_id = rf.stream_id and abs(f.established_s - rf.ref) <= 24),
  gm as (select rf.k, rf.ref, f.* from rf join fp f on f.stream_id = rf.stream_id and abs(f.floor_s - rf.ref) <= 24),
  ed as (select *, lead(hyp_id) over w as r_id, lead(time_s) over w as r_t, lead(start_s) over w as r_s, lead(recovery_s) over w as r_r, lead(novelty) over w as r_n from cx where sup window w as (partition by stream_id, k order by time_s)),
  rg as (select *, ref between start_s and recovery_s as in_l, ref between r_s and r_r as in_r,
    (select count(*) from cx c where c.stream_id = ed.stream_id and c.k = ed.k and c.time_s > ed.time_s and c.time_s < ed.r_t and c.n_basin = 0) as i_s, (select count(*) from cx c where c.stream_id = ed.stream_id and c.k = ed.k and c.time_s > ed.time_s and c.time_s < ed.r_t and c.n_structural = 0) as i_b,
    (select count(*) from cx c where c.stream_id = ed.stream_id and c.k = ed.k and c.time_s > ed.time_s and c.time_s < ed.r_t) as i_n
    from ed where r_id is not null and (ref between time_s and r_t or ref between start_s and recovery_s or ref between r_s and r_r)),
  pk as (select stream_id, k, max(novelty) as peak, count(*) filter (where sup) as n_handoffs, any_value(hyp_id) filter (where sup) as any_sup, bool_or(abs(time_s - ref) <= 2) as local_complete from cx group by stream_id, k),
  r1 as (select stream_id, k, count(*) as n_regions, any_value(rg) as g from rg group by stream_id, k),
  sy as (select rf.*, coalesce(n_regions = 1 and not (g.i_s > 0 and g.i_b > 0) and not (g.in_l and exists(select 1 from gm where gm.stream_id = rf.stream_id and gm.k = rf.k and gm.floor_s = gm.incoming_start_s and rf.ref <= gm.floor_s and gm.floor_s between g.start_s and g.recovery_s and gm.floor_s < g.r_t))
    and rf.ref between g.time_s and g.r_t and not coalesce(g.novelty = peak, false) and (not coalesce(g.r_n = peak, false) or (g.i_n = 1 and g.i_s = 1)), false) as symmetric_insert,
    coalesce(n_regions = 1 and g.novelty = peak and not coalesce(g.r_n = peak, false) and g.i_s = 1 and exists(select 1 from co where co.stream_id = rf.stream_id and co.k = rf.k and co.rise_s between g.r_s and g.r_r), false) as maybe_absorbed
    from rf left join r1 using (stream_id, k) left join pk using (stream_id, k)),
  af as (select stream_id, k, arg_min(hyp_id, time_s) as c_id, min(time_s) as c_t from cx where time_s > ref and comp group by stream_id, k),
  os as (select cx.*, c_t from cx join af using (stream_id, k) where time_s < ref and sup and c_t - ref < ref - time_s and not exists (select 1 from cx c where c.stream_id = cx.stream_id and c.k = cx.k and c.time_s > cx.time_s and c.time_s < c_t and c.sup)),
  ay2 as (select os.stream_id, os.k, count(*) = 1 and bool_and(coalesce(novelty = peak, false)) as asymmetric_insert from os join pk using (stream_id, k) group by os.stream_id, os.k),
  cn as (select stream_id, k, any_value(rg) as g from rg where time_s < ref and ref < r_t and not in_l and not in_r group by stream_id, k having count(*) = 1),
  nr as (select o.stream_id, o.k, o.ref, o.start_idx as oi, o.floor_s, z.start_idx as zi, z.start_s as zs, z.established_s as ze, z.strength, z.owned from co o join cz z on z.stream_id = o.stream_id and z.k = o.k
    where abs(o.floor_s - o.ref) <= 8 and z.strength >= pow(10, 0.6) and z.start_s between o.start_s and o.floor_s + least(2, greatest(0.5, 0.25 * greatest(0, o.floor_s - o.start_s))) and z.start_s < o.ref),
  fs as (select stream_id, k, ref, oi, floor_s, arg_min({'i': zi, 's': zs, 'e': ze, 'p': strength}, zs) as r from nr where not owned group by all),
  fo as (select fs.* from fs where not exists (select 1 from nr where nr.stream_id = fs.stream_id and nr.k = fs.k and nr.oi = fs.oi and nr.owned and nr.zs > fs.r.s and nr.strength >= fs.r.p)),
  fh as (select fo.*, case when cn.g is not null then cn.g.r_id else (select arg_min(c.hyp_id, c.time_s) from cx c where c.stream_id = fo.stream_id and c.k = fo.k and c.sup and c.time_s > greatest(fo.ref, fo.floor_s, fo.r.e)) end as h from fo left join cn using (stream_id, k)),
  sh as (select stream_id, k, arg_min({'h': h, 'o': oi, 'z': r.i}, row(-r.p, r.s, oi)) as s from fh where h is not null group by stream_id, k),
  ch as (select o.stream_id, o.k, abs(c.time_s - o.ref) as d, z.start_s - o.floor_s as gap, c.time_s - z.start_s as len, o.start_idx as oi, z.start_idx as zi, c.hyp_id as h from co o join cz z on z.stream_id = o.stream_id and z.k = o.k join cx c on c.stream_id = o.stream_id and c.k = o.k and c.sup
    where o.descent_ratio >= pow(10, 0.6) and z.strength >= pow(10, 0.6) and z.start_s - o.floor_s > least(2, greatest(0.5, 0.25 * greatest(0, o.floor_s - o.start_s))) and z.start_s - o.floor_s <= 8 and c.time_s - z.start_s > 8 and abs(c.time_s - o.ref) <= 8),
  lg as (select stream_id, k, any_value({'h': h, 'o': oi, 'z': zi}) as s from (select *, min(d) over (partition by stream_id, k) as m from ch) where abs(d - m) < 1e-9 group by stream_id, k having count(*) = 1),
  il as (select rf.stream_id, rf.k, coalesce(sh.s, case when cn.g is null then lg.s end, case when cn.g is not null then {'h': cn.g.r_id, 'o': null, 'z': null} end) as s, cn.g is not null as has_region from rf left join cn using (stream_id, k) left join sh using (stream_id, k) left join lg using (stream_id, k)),
  dp as (select stream_id, k, ref, count(*) as n, any_value(co) as d from co where floor_rms = (select min(o.floor_rms) from co o where o.stream_id = co.stream_id and o.k = co.k) group by stream_id, k, ref),
  fl as (select dp.stream_id, dp.k, d.floor_s as floor_s, d.start_idx as floor_fade, case when own = 1 then hid end as handoff_id from (select dp.*, (select count(*) from cx c where c.stream_id = dp.stream_id and c.k = dp.k and c.sup and c.time_s >= d.floor_s and d.floor_s between c.start_s and c.recovery_s) as own,
      (select min(c.hyp_id) from cx c where c.stream_id = dp.stream_id and c.k = dp.k and c.sup and c.time_s >= d.floor_s and d.floor_s between c.start_s and c.recovery_s) as hid, exists(select 1 from co o where o.stream_id = dp.stream_id and o.k = dp.k and o.start_s > d.floor_s and o.start_s <= dp.ref) as later from dp) dp
    where n = 1 and d.rise_s is null and d.floor_s <= ref and (own = 1 or later)),
  lt as (select rf.stream_id, rf.k, max(rise_s) as rise_at from rf join ri on ri.stream_id = rf.stream_id and rise_s - rf.ref >= 1 group by rf.stream_id, rf.k),
  ev as (select rf.*, sy.symmetric_insert, coalesce(asymmetric_insert, false) as asymmetric_insert, il.s is not null as island, il.s is not null and has_region as island_region, il.s as isl, not sy.symmetric_insert and maybe_absorbed as absorbed, fl.floor_s, fl.floor_fade, fl.handoff_id, rise_at,
    coalesce(n_handoffs, 0) as n_handoffs, coalesce(local_complete, false) as local_complete, any_sup, ao.f as of, ao.h as oh, ai.f as jf, ai.h as jh, ai.start as js
    from rf left join sy using (stream_id, k) left join ay2 using (stream_id, k) left join il using (stream_id, k) left join fl using (stream_id, k) left join lt using (stream_id, k) left join pk using (stream_id, k) left join ao using (stream_id, k) left join ai using (stream_id, k))"""
)
ALL_SQL = FIXED_SQL + ", " + PROPOSALS_SQL + ", cx as (select ca.stream_id, k, candidate_s as ref, sf.* exclude (stream_id) from ca join sf on sf.stream_id = ca.stream_id and abs(time_s - candidate_s) <= 24)"

ROUTE_SQL = (
    ALL_SQL + ", " + EVIDENCE_SQL + ", " + BASINS_SQL_OF_LEVELS
    + """, lb as (select rf.stream_id, rf.k, count(*) as n from rf join qb on qb.stream_id = rf.stream_id and rf.ref - c between 0.5 and 2.5 group by rf.stream_id, rf.k),
    x as (select ev.*, coalesce(lb.n, 0) as n_basins, rise_at is not null as rise, of is not null and jf is not null as two_sided, coalesce(n_handoffs = 1 and oh = any_sup and jh = any_sup, false) as shared,
      (select count(*) from gm where gm.stream_id = ev.stream_id and gm.k = ev.k and gm.start_idx = ev.of and gm.incoming_start_s = ev.js) as n_rec,
      coalesce(of is not null and jf is null and (select count(*) > 0 and bool_and(incoming_established_s < ev.ref) from gm where gm.stream_id = ev.stream_id and gm.k = ev.k and gm.start_idx = ev.of), false) as stale from ev left join lb using (stream_id, k)),
    ro as (select stream_id, k, ref as reference_s, symmetric_insert, asymmetric_insert, island_region, island, handoff_id is not null as floor_handoff, rise, rise_at, cast(n_handoffs as int) as n_handoffs, case
      when symmetric_insert or asymmetric_insert then 'BOUNDED_INSERT' when island_region then 'INTERSTITIAL' when handoff_id is not null then 'FADE' when island then 'INTERSTITIAL'
      when rise and n_basins > 0 and not stale and n_handoffs >= 2 then case when n_rec <> 1 or absorbed then 'INTERSTITIAL' when two_sided then 'FADE' else 'INTERSTITIAL' end
      when rise and n_basins > 0 and not stale then 'FADE' when n_handoffs >= 2 then 'INTERSTITIAL' when floor_s is not null then 'FADE'
      when local_complete and not rise and shared then 'HARD_CUT' else 'AMBIGUOUS' end as kind from x)"""
)
INSERT_SQL = """, y as (select rf.stream_id, rf.k, rf.ref, n_regions, g, p,
      (select any_value(c) from cx c where c.stream_id = rf.stream_id and c.k = rf.k and c.time_s > g.time_s and c.time_s < g.r_t) as inner_,
      (select count(*) from cx c where c.stream_id = rf.stream_id and c.k = rf.k and c.time_s > p.time_s and c.time_s < g.time_s) as n_mid, (select bool_and(c.n_basin = 0) from cx c where c.stream_id = rf.stream_id and c.k = rf.k and c.time_s > p.time_s and c.time_s < g.time_s) as plain_mid
      from (select rf.*, n_regions, g, (select arg_max(c, c.time_s) from cx c where c.stream_id = rf.stream_id and c.k = rf.k and c.sup and c.time_s < g.time_s) as p from rf left join r1 using (stream_id, k)) rf),
    sd as (select stream_id, k, ref, case
      when g.i_n = 1 and inner_.n_basin = 0 and abs(inner_.time_s - ref) < abs(g.time_s - ref) and abs(inner_.time_s - ref) <= abs(g.r_t - ref) then {'kind': 'HARD_CUT', 'i': inner_.time_s, 'o': inner_.time_s}
      when p is not null and n_mid > 0 and plain_mid and p.time_s < g.r_t then {'kind': 'EXCLUSION', 'i': g.r_t, 'o': p.time_s}
      when least(g.time_s, g.recovery_s) < g.r_t then {'kind': 'EXCLUSION', 'i': g.r_t, 'o': least(g.time_s, g.recovery_s)} end as d from y where n_regions = 1),
    o1 as (select stream_id, k, any_value(os) as a from os group by stream_id, k having count(*) = 1),
    oo as (select o1.*, (select arg_max(c, c.time_s) from cx c where c.stream_id = o1.stream_id and c.k = o1.k and c.sup and c.time_s < a.time_s) as p, (select count(*) from rg where rg.stream_id = o1.stream_id and rg.k = o1.k and rg.hyp_id = a.hyp_id) as n_own, (select min(r_t) from rg where rg.stream_id = o1.stream_id and rg.k = o1.k and rg.hyp_id = a.hyp_id) as own_t,
      (select any_value(c) from cx c where c.stream_id = o1.stream_id and c.k = o1.k and c.time_s = a.c_t and c.comp) as z from o1),
    op as (select oo.*, coalesce((select bool_and(c.n_basin = 0) from cx c where c.stream_id = oo.stream_id and c.k = oo.k and c.time_s > p.time_s and c.time_s < a.time_s), true) as plain from oo),
    ad as (select stream_id, k, a.ref as ref, case when n_own = 1 and p is not null and plain and p.time_s < own_t then {'kind': 'EXCLUSION', 'i': own_t, 'o': p.time_s}
      when a.recovery_s < coalesce(z.recovery_s, z.time_s) then {'kind': 'EXCLUSION', 'i': coalesce(z.recovery_s, z.time_s), 'o': a.recovery_s} end as d from op where not exists (select 1 from r1 where r1.stream_id = op.stream_id and r1.k = op.k and n_regions = 1))
    select stream_id, k, ref as reference_s, d.kind as kind, d.i as incoming_start_s, d.o as outgoing_end_s from (select * from sd union all select * from ad) where d is not null"""

SQL = {
    "q30_cluster": B.with_sql("pc", PROPOSALS_SQL + " select * from hy", recursive=True),
    "q31_confidence": B.with_sql("pc", PROPOSALS_SQL + " select stream_id, hyp_id, time_s, case when n_basin > 0 and n_structural > 0 and depth <= 0.06 and novelty >= 0.35 and novelty - depth >= 0.15 then 'HIGH' else 'UNRESOLVED' end as confidence from hy", recursive=True),
    "q57_symmetric_regions": B.with_sql(
        "fr pc",
        ALL_SQL.replace("10.0::double", "2.5::double").replace("last_end_s / 10", "last_end_s / 2.5")
        + """, ed as (select *, lead(hyp_id) over w as r_id, lead(time_s) over w as r_t, lead(start_s) over w as r_s, lead(recovery_s) over w as r_r from cx where sup window w as (partition by stream_id, k order by time_s))
    select stream_id, k, hyp_id as left_id, r_id as right_id, cast((select count(*) from cx c where c.stream_id = ed.stream_id and c.k = ed.k and c.time_s > ed.time_s and c.time_s < ed.r_t) as int) as n_interior
    from ed where r_id is not null and (ref between time_s and r_t or ref between start_s and recovery_s or ref between r_s and r_r)""",
        recursive=True,
    ),
    "q58_asymmetric_regions": B.with_sql(
        "fr pc",
        ALL_SQL
        + """, af as (select stream_id, k, arg_min(hyp_id, time_s) as c_id, min(time_s) as c_t from cx where time_s > ref and comp group by stream_id, k),
    pr as (select cx.*, c_id, c_t from cx join af using (stream_id, k) where time_s < ref and sup and c_t - ref < ref - time_s)
    select stream_id, k, hyp_id as primary_id, c_id as complementary_id, cast((select count(*) from cx c where c.stream_id = pr.stream_id and c.k = pr.k and c.time_s > pr.time_s and c.time_s < pr.c_t) as int) as n_interior
    from pr where not exists (select 1 from cx c where c.stream_id = pr.stream_id and c.k = pr.k and c.time_s > pr.time_s and c.time_s < pr.c_t and c.sup)""",
        recursive=True,
    ),
    "q59_fade_association": B.with_sql(
        "fr pc",
        ALL_SQL + ", " + FADES_SQL
        + """ select coalesce(ao.stream_id, ai.stream_id) as stream_id, coalesce(ao.k, ai.k) as k, ao.floor as outgoing_floor_s, ao.h as outgoing_id, ao.d as outgoing_distance_s, ai.start as incoming_start_s, ai.h as incoming_id, ai.d as incoming_distance_s
    from ao full join ai on ai.stream_id = ao.stream_id and ai.k = ao.k""",
        recursive=True,
    ),
    "q80_acoustic_island": B.with_sql(
        "fr pc",
        ALL_SQL.replace("10.0::double", "2.5::double").replace("last_end_s / 10", "last_end_s / 2.5") + ", " + EVIDENCE_SQL + " select stream_id, k, isl.h as handoff_id, isl.o as decay_idx, isl.z as reset_idx, island_region as has_region from ev where island",
        recursive=True,
    ),
    "q82_fade_geometry": B.with_sql(
        "fr pc",
        ALL_SQL + ", " + EVIDENCE_SQL
        + """, x as (select ev.*, ref - 1.25::double as sel, case when handoff_id is null then ref else (select time_s from cx c where c.stream_id = ev.stream_id and c.k = ev.k and c.hyp_id = handoff_id) end as fin,
      (select count(*) from gm where gm.stream_id = ev.stream_id and gm.k = ev.k and gm.start_idx = ev.of and gm.incoming_start_s = ev.js) as np, (select min(floor_s) from gm where gm.stream_id = ev.stream_id and gm.k = ev.k and gm.start_idx = ev.of and gm.incoming_start_s = ev.js) as pf,
      (select time_s from cx c where c.stream_id = ev.stream_id and c.k = ev.k and c.hyp_id = oh) as ot, (select time_s from cx c where c.stream_id = ev.stream_id and c.k = ev.k and c.hyp_id = jh) as it from ev),
    d as (select stream_id, k, ref as reference_s, case
      when floor_s < fin then {'kind': 'EXCLUSION', 'i': fin, 'o': floor_s}
      when np = 1 then {'kind': case when js = pf then 'HARD_CUT' when js < pf then 'CROSSFADE' else 'EXCLUSION' end, 'i': js, 'o': pf}
      when rise_at is null then {'kind': 'HARD_CUT', 'i': sel, 'o': sel}
      when sel >= rise_at then null
      when ref - sel >= 0 and rise_at - ref > ref - sel then {'kind': 'HARD_CUT', 'i': sel, 'o': sel}
      when it < ot then {'kind': 'CROSSFADE', 'i': it, 'o': ot}
      else {'kind': 'CROSSFADE', 'i': sel, 'o': rise_at} end as d from x)
    select stream_id, k, reference_s, d.kind as kind, d.i as incoming_start_s, d.o as outgoing_end_s from d where d is not null""",
        recursive=True,
    ),
    "q60_route": B.with_sql("fr pc", ROUTE_SQL + " select stream_id, k, reference_s, symmetric_insert, asymmetric_insert, island_region, island, floor_handoff, rise, n_handoffs, kind from ro", recursive=True),
    "q107_routing_trace": B.with_sql("fr pc", ROUTE_SQL + " select stream_id, k, kind, n_handoffs, rise_at, symmetric_insert from ro", recursive=True),
    "q78_insert_geometry": B.with_sql("fr pc", (ALL_SQL + ", " + EVIDENCE_SQL).replace("10.0::double", "2.5::double").replace("last_end_s / 10", "last_end_s / 2.5") + INSERT_SQL, recursive=True),
    "q61_specialist_geometry": B.with_sql(
        "fr pc",
        ALL_SQL
        + """, q as (select stream_id, k, candidate_s as ref, candidate_s - 1.25::double as sel from ca),
    g as (select q.*, (select arg_min({'n': c.minimum_s, 's': c.start_s, 'r': c.recovery_s, 'b': c.n_basin, 't': c.n_structural}, row(abs(c.minimum_s - sel), c.minimum_s)) from cx c where c.stream_id = q.stream_id and c.k = q.k and c.start_s is not null and sel between c.start_s and c.recovery_s) as s,
      (select arg_min({'n': c.minimum_s, 's': c.start_s, 'r': c.recovery_s, 'b': c.n_basin, 't': c.n_structural}, row(abs(c.minimum_s - c.ref), c.minimum_s)) from cx c where c.stream_id = q.stream_id and c.k = q.k and c.start_s is not null and c.ref between c.start_s and c.recovery_s) as r,
      (select count(*) from cx c where c.stream_id = q.stream_id and c.k = q.k and sel < c.start_s and c.recovery_s < c.ref) as ne, (select min(c.recovery_s) from cx c where c.stream_id = q.stream_id and c.k = q.k and sel < c.start_s and c.recovery_s < c.ref) as er,
      (select count(c.start_s) from cx c where c.stream_id = q.stream_id and c.k = q.k) as ng, (select arg_min(c.time_s, row(abs(c.time_s - c.ref), c.time_s)) from cx c where c.stream_id = q.stream_id and c.k = q.k) as nt from q)
    select stream_id, k, ref as reference_s, sel as selected_s, case
      when s is not null then case when sel >= s.n then s.r when s.t > 0 and ref >= s.r then s.r when s.b > 0 and s.t = 0 and ref between s.s and s.n then ref when ref between s.s and s.n then s.n else sel end
      when r is not null then case when ref > r.n then r.r when r.b > 0 and r.t = 0 then ref else r.n end
      when ne = 1 then er when ng > 0 then sel else coalesce(nt, sel) end as boundary_s from g""",
        recursive=True,
    ),
    "q79_supported_exclusion": B.with_sql(
        "fr pc",
        ALL_SQL.replace("10.0::double", "2.5::double").replace("last_end_s / 10", "last_end_s / 2.5")
        + """, s as (select stream_id, k, candidate_s as ref, candidate_s - 0.25::double as sel from ca),
    n as (select s.*, (select arg_max({'t': c.time_s, 'r': c.recovery_s, 'u': c.sup}, c.time_s) from cx c where c.stream_id = s.stream_id and c.k = s.k and c.time_s < sel) as l,
      (select arg_min({'t': c.time_s, 'r': c.recovery_s, 'u': c.sup}, c.time_s) from cx c where c.stream_id = s.stream_id and c.k = s.k and c.time_s > sel) as r from s),
    e as (select *, case when sel - l.t <= r.t - sel then least(l.t, l.r) else sel end as o, greatest(r.t, r.r) as i from n where l.u and r.u)
    select stream_id, k, ref as reference_s, sel as selected_s, 'EXCLUSION' as kind, i as incoming_start_s, o as outgoing_end_s from e where o < i""",
        recursive=True,
    ),
}
