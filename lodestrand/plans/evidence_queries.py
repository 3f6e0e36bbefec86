"""Queries over sides of a boundary: centres, spreads, context, shared edges and the multisignal ranking, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import vectors as V
from lodestrand.operators import detect as D
from lodestrand.operators import edges as E
from lodestrand.operators import rank as R
from lodestrand.sources import bindings as B

from .detector_queries import FEATURES_SQL, NOVELTY_SQL, _features, _round
from .detector_queries import SQL as DETECTOR_SQL
from .rank_queries import COS_SQL, SCAN_SQL
from .timeline_queries import FIXED_SQL, _fixed

SIDES = {"d250": 1, "d500": 2, "d1": 3, "d2": 4}


def _boundaries(spark, sf):
    return B.vectors(spark, sf).where("idx % 3 = 0").select("stream_id", F.col("idx").alias("k"), F.col("idx").alias("at"))


def q99_before_after(spark, sf):
    return _round(R.before_after(B.vectors(spark, sf), _boundaries(spark, sf), 4, 1), "between", "before_sequential", "after_sequential", "before_spread", "after_spread")


def q100_local_discontinuity(spark, sf):
    return _round(R.local_discontinuity(B.vectors(spark, sf), _boundaries(spark, sf), SIDES), *SIDES)


def q101_context_change(spark, sf):
    times = _fixed(spark, sf).select("stream_id", "k", F.col("candidate_s").alias("time_s"))
    # features are half a second apart here, as levels are; streams are short
    return _round(R.context_change(_features(spark, sf), times, 2.5, 2, 1), "change")


def _scores(spark, sf):
    return _round(E.handoff_scores(B.vectors(spark, sf), (3, 4), V.cosine_distance), "score").select("stream_id", (F.col("idx") * 0.5).alias("time_s"), "score")


def q102_handoff_scores(spark, sf):
    return _scores(spark, sf)


def q103_spectral_handoff(spark, sf):
    references = B.vectors(spark, sf).where("idx % 10 = 5").select("stream_id", F.col("idx").alias("k"), (F.col("idx") * 0.5).alias("reference_s"))
    return E.spectral_handoff(_scores(spark, sf), references, 4.0, 0.3, 0.001)


def q104_shared_edge(spark, sf):
    provisional = _fixed(spark, sf).select("stream_id", "k", F.col("candidate_s").alias("provisional_s"))
    scan = _round(E.edge_scan(B.levels(spark, sf)), "energy").withColumn("spectral", F.round(F.col("post") / (F.col("pre") + F.col("post")), 6))
    return E.shared_edge(scan, provisional, 2.0)


def q105_evidence_record(spark, sf):
    """Measurements of each boundary in one record, those of its own first."""
    spectral = q99_before_after(spark, sf).select("stream_id", "k", "between")
    local = q100_local_discontinuity(spark, sf)
    base = _boundaries(spark, sf).select("stream_id", "k", F.when(F.col("k") % 2 == 0, F.lit(0.5)).alias("d250"))
    out = R.transition_evidence(base, spectral, local=local)
    return out.select("stream_id", "k", "between", *SIDES, "label")


def q106_multisignal(spark, sf):
    levels = B.levels(spark, sf)
    reference = _fixed(spark, sf).select("stream_id", "k", F.col("candidate_s").alias("reference_s"))
    basins = D.quiet_basins(levels).select("stream_id", F.col("center_s").alias("time_s"))
    series = _round(D.novelty(_features(spark, sf), 3), "novelty").select("stream_id", (F.col("idx") * 0.5).alias("time_s"), F.col("novelty").alias("strength"))
    grid = levels.select("stream_id", F.explode(F.array("start_s", F.col("start_s") + 0.25)).alias("time_s"), "rms")
    horizons = grid.select("stream_id", "time_s", *[F.round(F.col("rms") % p, 6).alias(n) for n, p in (("d250", 7), ("d500", 11), ("d1", 13), ("d2", 17))])
    regime = grid.select("stream_id", "time_s", F.array(F.col("rms") + 1, F.col("rms") % 5 + 1, F.col("rms") % 3 + 1).alias("ratios"))
    novelty = grid.select("stream_id", "time_s", F.round(F.col("rms") % 19, 6).alias("novelty"))
    out = R.multisignal(reference, basins, series, horizons, regime, novelty)
    return _round(out, "family_rrf", "mfcc_geo").select("stream_id", "k", "time_s", "sources", "mfcc_geo", "forward_novelty", "short_rank", "long_rank", "regime_rank", "family_rrf", "selected")


QUERIES = {f.__name__: f for f in (q99_before_after, q100_local_discontinuity, q101_context_change, q102_handoff_scores, q103_spectral_handoff, q104_shared_edge, q105_evidence_record, q106_multisignal)}

PROFILE_SQL = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: pow(abs(z[1] - z[2]) / greatest(abs(z[1]) + abs(z[2]), 1e-12), 2))))"
BOUNDARY_SQL = "bo as (select stream_id, idx as k from ve where idx % 3 = 0)"


def _sides_sql(name: str, side: int, guard: int) -> str:
    """Per boundary and side: centre, sequential variability and spread, as {name}(stream_id, k, side, center, seq, spread)."""
    return f"""{name}m as (select bo.stream_id, bo.k, case when ve.idx < bo.k then 0 else 1 end as side, ve.idx, ve.vec from bo join ve on ve.stream_id = bo.stream_id and (ve.idx between bo.k - {guard} - {side} and bo.k - {guard} - 1 or ve.idx between bo.k + {guard} and bo.k + {guard} + {side} - 1)),
    {name}w as (select stream_id, k from {name}m group by all having count(*) = {2 * side}),
    {name}c as (select stream_id, k, side, list(m order by dim) as center from (select stream_id, k, side, dim, median(x) as m from (select stream_id, k, side, unnest(vec) as x, generate_subscripts(vec, 1) as dim from {name}m semi join {name}w using (stream_id, k)) group by all) group by all),
    {name}q as (select stream_id, k, side, coalesce(median(case when p is not null then {PROFILE_SQL.format(a='p', b='vec')} end), 0) as seq from (select *, lag(vec) over (partition by stream_id, k, side order by idx) as p from {name}m) group by all),
    {name}s as (select stream_id, k, side, median({PROFILE_SQL.format(a='vec', b='center')}) as spread from {name}m join {name}c using (stream_id, k, side) group by all),
    {name} as (select * from {name}c join {name}q using (stream_id, k, side) join {name}s using (stream_id, k, side)),
    {name}b as (select a.stream_id, a.k, round({PROFILE_SQL.format(a='a.center', b='z.center')}, 6) as between_, a.seq as aq, z.seq as zq, a.spread as asp, z.spread as zsp from {name} a join {name} z on z.stream_id = a.stream_id and z.k = a.k and a.side = 0 and z.side = 1)"""


LOCAL_SQL = ", ".join(_sides_sql(n, side, 0) for n, side in SIDES.items())
LOCAL_JOIN = " from bo " + " ".join(f"join {n}b using (stream_id, k)" for n in SIDES)
SCORES_SQL = (
    "un as (select stream_id, idx, unnest(vec) as x, generate_subscripts(vec, 1) as dim from ve),\n"
    + ",\n".join(
        f"""h{n} as (select stream_id, idx, list(a order by dim) as a, list(b order by dim) as b from (select stream_id, idx, dim, avg(x) over p as a, avg(x) over f as b, count(*) over p as na, count(*) over f as nb from un
      window p as (partition by stream_id, dim order by idx rows between {n} preceding and 1 preceding), f as (partition by stream_id, dim order by idx rows between current row and {n - 1} following)) where na = {n} and nb = {n} group by all)"""
        for n in (3, 4)
    )
    + ",\nso as (select h3.stream_id, h3.idx * 0.5::double as time_s, round(least(" + COS_SQL.format(a="h3.a", b="h3.b") + ", " + COS_SQL.format(a="h4.a", b="h4.b") + "), 6) as score from h3 join h4 using (stream_id, idx))"
)

SQL = {
    "q99_before_after": B.with_sql("ve", BOUNDARY_SQL + ", " + _sides_sql("x", 4, 1) + " select stream_id, k, between_ as between, round(aq, 6) as before_sequential, round(zq, 6) as after_sequential, round(asp, 6) as before_spread, round(zsp, 6) as after_spread from xb"),
    "q100_local_discontinuity": B.with_sql("ve", BOUNDARY_SQL + ", " + LOCAL_SQL + " select stream_id, k, " + ", ".join(f"{n}b.between_ as {n}" for n in SIDES) + LOCAL_JOIN),
    "q101_context_change": B.with_sql(
        "fr pc",
        FIXED_SQL + ", " + FEATURES_SQL
        + """, cc as (select stream_id, idx, idx * 2.5::double as t, count(*) over b as nb, count(*) over a as na, avg(rms) over b as b1, avg(rms) over a as a1, avg(zcr) over b as b2, avg(zcr) over a as a2, avg(mean_abs_delta) over b as b3, avg(mean_abs_delta) over a as a3, avg(crest) over b as b4, avg(crest) over a as a4 from fe
      window b as (partition by stream_id order by idx rows between 3 preceding and 2 preceding), a as (partition by stream_id order by idx rows between 1 following and 2 following)),
    hi as (select ca.*, (select arg_min({'c': case when nb = 2 and na = 2 then sqrt((a1 - b1) ** 2 + (a2 - b2) ** 2 + (a3 - b3) ** 2 + ((a4 - b4) / 4) ** 2) end}, row(abs(t - candidate_s), t)) from cc where cc.stream_id = ca.stream_id) as h from ca)
    select stream_id, k, candidate_s as time_s, round(h.c, 6) as change from hi""",
    ),
    "q102_handoff_scores": B.with_sql("ve", SCORES_SQL + " select * from so"),
    "q103_spectral_handoff": B.with_sql(
        "ve",
        SCORES_SQL
        + """, pe as (select *, coalesce(score >= lag(score) over w, true) and coalesce(score >= lead(score) over w, true) as peak from so window w as (partition by stream_id order by time_s)),
    re as (select stream_id, idx as k, idx * 0.5::double as ref from ve where idx % 10 = 5),
    nr as (select re.stream_id, k, pe.time_s, score, peak from re join pe on pe.stream_id = re.stream_id and abs(pe.time_s - ref) <= 4),
    be as (select stream_id, k, max(score) as top, arg_min(time_s, row(-score, time_s)) as handoff_s from nr group by all having max(score) >= 0.3)
    select be.stream_id, be.k, handoff_s from be where coalesce(top - (select max(score) from nr where nr.stream_id = be.stream_id and nr.k = be.k and peak and abs(nr.time_s - handoff_s) >= 1) >= 0.001, true)""",
    ),
    "q104_shared_edge": B.with_sql(
        "fr",
        FIXED_SQL + ", " + SCAN_SQL
        + """, pr as (select stream_id, time_s, min(round(energy, 6)) as energy, min(round(post / (pre + post), 6)) as spectral from sc where horizon_s <= 1 group by all having count(*) = 2 and min(round(energy, 6)) >= 0.25 and min(post - pre) > 0 and max(post) >= 1e-4)
    select ca.stream_id, k, candidate_s as provisional_s, time_s as edge_s, energy, spectral from ca join pr on pr.stream_id = ca.stream_id and time_s < candidate_s and candidate_s - time_s <= 2
    qualify row_number() over (partition by ca.stream_id, k order by energy desc, spectral desc, time_s desc) = 1""",
    ),
    "q105_evidence_record": B.with_sql(
        "ve",
        BOUNDARY_SQL + ", " + _sides_sql("x", 4, 1) + ", " + LOCAL_SQL + ", lo as (select stream_id, k, " + ", ".join(f"{n}b.between_ as {n}" for n in SIDES) + LOCAL_JOIN + ")"
        + " select bo.stream_id, bo.k, between_ as between, coalesce(case when bo.k % 2 = 0 then 0.5::double end, d250) as d250, d500, d1, d2, 'UNRESOLVED' as label from bo left join xb using (stream_id, k) left join lo using (stream_id, k)",
    ),
    "q106_multisignal": DETECTOR_SQL["q20_quiet_basin"].split("\n        select stream_id, l as left_idx")[0]
    + ", qb as (select stream_id, (l + r + 1) * 0.25::double as time_s from (select *, row_number() over (partition by stream_id, l, r order by rms, idx) as n from e where (r - l + 1) * 0.5 <= 1.5) where n = 1), "
    + B.SQL["fr"] + ", " + B.SQL["pc"] + ", " + FIXED_SQL + ", " + NOVELTY_SQL
    + """, gb as (select ca.stream_id, k, time_s from ca join qb on qb.stream_id = ca.stream_id and candidate_s - time_s between 1 and 7),
    gs as (select ca.stream_id, k, idx * 0.5::double as time_s, novelty as s from ca join no on no.stream_id = ca.stream_id and candidate_s - idx * 0.5 between 1 and 7),
    gm as (select * from (select *, lag(s) over w as b, lead(s) over w as a from gs window w as (partition by stream_id, k order by time_s)) where (b is null or s >= b) and (a is null or s >= a)),
    un as (select stream_id, k, time_s, 0 as o, 'BASIN' as src from gb union all select stream_id, k, time_s, 1, 'D2' from gm),
    uu as (select stream_id, k, round_even(time_s, 3) as time_s, string_agg(distinct src, '+' order by src) as sources from un group by all),
    gr as (select stream_id, start_s as time_s, rms from lv union all select stream_id, start_s + 0.25::double, rms from lv),
    cd as (select uu.*, round(rms % 7, 6) as d250, round(rms % 11, 6) as d500, round(rms % 13, 6) as d1, round(rms % 17, 6) as d2, exp((ln(rms + 1) + ln(rms % 5 + 1) + ln(rms % 3 + 1)) / 3) as geo, round(rms % 19, 6) as nov from uu join gr on gr.stream_id = uu.stream_id and round_even(gr.time_s, 3) = uu.time_s),
    rk as (select *, row_number() over (partition by stream_id, k order by d250 desc, time_s) as r1, row_number() over (partition by stream_id, k order by d500 desc, time_s) as r2, row_number() over (partition by stream_id, k order by d1 desc, time_s) as r3,
      row_number() over (partition by stream_id, k order by d2 desc, time_s) as r4, row_number() over (partition by stream_id, k order by geo desc, time_s) as r5 from cd),
    rr as (select *, r1 + r2 + r3 - greatest(r1, r2, r3) - least(r1, r2, r3) as sr from rk),
    rf as (select *, 1.0::double / sr + 1.0::double / r4 + 1.0::double / r5 as rrf from rr),
    ra as (select *, row_number() over (partition by stream_id, k order by rrf desc, time_s) as ar, row_number() over (partition by stream_id, k order by nov desc, time_s) as nr from rf)
    select stream_id, k, time_s, sources, round(geo, 6) as mfcc_geo, nov as forward_novelty, sr as short_rank, r4 as long_rank, r5 as regime_rank, round(rrf, 6) as family_rrf,
      row_number() over (partition by stream_id, k order by greatest(ar, nr), ar + nr, ar, nr, time_s) = 1 as selected from ra""",
}
