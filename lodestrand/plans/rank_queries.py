"""Queries over ranks, vectors and edges, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrand.functions import vectors as V
from lodestrand.operators import detect as D
from lodestrand.operators import edges as E
from lodestrand.operators import rank as R
from lodestrand.sources import bindings as B

from .detector_queries import NOVELTY_SQL, SQL as DETECTOR_SQL, _features, _round
from .timeline_queries import FIXED_SQL, _fixed


def _candidates(spark, sf):
    rows = B.read(spark, sf, "lineitem")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return rows.select(
        F.col("l_orderkey").alias("stream_id"), seq.cast("double").alias("time_s"), F.col("l_quantity").alias("d250"), F.col("l_discount").alias("d500"), F.col("l_tax").alias("d1"), F.col("l_extendedprice").alias("d2"), (F.col("l_partkey") % 101).cast("double").alias("mfcc_geo"), (F.col("l_suppkey") % 7).cast("double").alias("forward_novelty")
    )


def q32_union_candidates(spark, sf):
    reference = _fixed(spark, sf).select("stream_id", "k", F.col("candidate_s").alias("reference_s"))
    basins = D.quiet_basins(B.levels(spark, sf)).select("stream_id", F.col("center_s").alias("time_s"))
    series = _round(D.novelty(_features(spark, sf), 3), "novelty").select("stream_id", (F.col("idx") * 0.5).alias("time_s"), F.col("novelty").alias("strength"))
    return R.union_candidates(reference, basins, series)


def q33_family_rrf(spark, sf):
    return _round(R.family_rrf(_candidates(spark, sf).drop("forward_novelty")), "family_rrf")


def q34_minimax(spark, sf):
    rows = _candidates(spark, sf)
    ranked = _round(R.family_rrf(rows), "family_rrf")
    return R.minimax(ranked.select("stream_id", "time_s", "family_rrf", "forward_novelty"))


def q35_cosine(spark, sf):
    return R.consecutive(B.vectors(spark, sf), V.cosine_distance, "distance")


def q36_js_divergence(spark, sf):
    mass = B.vectors(spark, sf).withColumn("vec", F.transform("vec", F.abs))
    return R.consecutive(mass, V.js_divergence, "divergence")


def q37_profile_distance(spark, sf):
    return R.consecutive(B.vectors(spark, sf), V.profile_distance, "distance")


def q38_robust_normalise(spark, sf):
    return _round(R.robust_scale(B.vectors(spark, sf)), "z")


def q39_pairwise_variability(spark, sf):
    return _round(R.bin_variability(B.vectors(spark, sf), 5), "variability")


def q40_contraction(spark, sf):
    return R.contraction(R.bin_variability(B.vectors(spark, sf), 5))


def q41_geomean(spark, sf):
    x = B.levels(spark, sf).groupBy("stream_id", F.floor(F.col("idx") / 5).cast("long").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "rms"))), lambda s: s["rms"]).alias("v"))
    return x.select("stream_id", "block", F.round(V.geomean(F.col("v")), 6).alias("geomean"))


def q42_regime_ratio(spark, sf):
    return R.regime_ratio(R.block_means(B.vectors(spark, sf), 3))


def q43_forward_novelty(spark, sf):
    return R.forward_novelty(B.vectors(spark, sf), 4, 4)


def q44_prefix_means(spark, sf):
    spans = _fixed(spark, sf).select("stream_id", "k", (F.col("candidate_s") - 4).alias("from_s"), F.col("candidate_s").alias("to_s"))
    return _round(E.prefix_means(B.levels(spark, sf), spans), "mean_rms")


def q45_edge_scan(spark, sf):
    return _round(E.edge_scan(B.levels(spark, sf)), "pre", "post", "energy")


def q46_temporal_edge(spark, sf):
    provisional = _fixed(spark, sf).select("stream_id", "k", F.col("candidate_s").alias("provisional_s"))
    return E.temporal_edge(_round(E.edge_scan(B.levels(spark, sf)), "energy"), provisional)


QUERIES = {
    f.__name__: f
    for f in (q32_union_candidates, q33_family_rrf, q34_minimax, q35_cosine, q36_js_divergence, q37_profile_distance, q38_robust_normalise, q39_pairwise_variability, q40_contraction, q41_geomean, q42_regime_ratio, q43_forward_novelty, q44_prefix_means, q45_edge_scan, q46_temporal_edge)
}

CANDIDATES_SQL = """cd as (select l_orderkey as stream_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as double) as time_s,
  l_quantity as d250, l_discount as d500, l_tax as d1, l_extendedprice as d2, cast(l_partkey % 101 as double) as mfcc_geo, cast(l_suppkey % 7 as double) as forward_novelty from lineitem),
rk as (select *, row_number() over (partition by stream_id order by d250 desc, time_s) as r1, row_number() over (partition by stream_id order by d500 desc, time_s) as r2, row_number() over (partition by stream_id order by d1 desc, time_s) as r3,
  row_number() over (partition by stream_id order by d2 desc, time_s) as r4, row_number() over (partition by stream_id order by mfcc_geo desc, time_s) as r5 from cd),
rr as (select *, r1 + r2 + r3 - greatest(r1, r2, r3) - least(r1, r2, r3) as sr, round(1.0::double / (r1 + r2 + r3 - greatest(r1, r2, r3) - least(r1, r2, r3)) + 1.0::double / r4 + 1.0::double / r5, 6) as rrf from rk)"""
PAIR_SQL = "pa as (select stream_id, idx, vec as b, lag(vec) over (partition by stream_id order by idx) as a from ve)"
COS_SQL = "case when sqrt(list_sum(list_transform({a}, lambda x: x * x))) * sqrt(list_sum(list_transform({b}, lambda x: x * x))) <= 1e-12 then 0 else 1 - greatest(-1, least(1, list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform({a}, lambda x: x * x))) * sqrt(list_sum(list_transform({b}, lambda x: x * x)))))) end"
VARIABILITY_SQL = """bv as (select a.stream_id, a.idx // 5 as bin, median(sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len(a.vec))) as variability
  from ve a join ve b on a.stream_id = b.stream_id and a.idx // 5 = b.idx // 5 and a.idx < b.idx group by all)"""
BLOCK_SQL = """bx as (select stream_id, idx // 3 as block, dim, avg(x) as x from (select stream_id, idx, unnest(vec) as x, generate_subscripts(vec, 1) as dim from ve) group by all having count(*) = 3),
bm as (select stream_id, block, list(x order by dim) as vec from bx group by all)"""
SCAN_SQL = """ls as (select stream_id, start_s as time_s, h.h as horizon_s, (select avg(v.rms) from lv v where v.stream_id = lv.stream_id and v.idx between lv.idx - cast(h.h * 2 as int) and lv.idx - 1) as pre,
  (select avg(v.rms) from lv v where v.stream_id = lv.stream_id and v.idx between lv.idx and lv.idx + cast(h.h * 2 as int) - 1) as post from lv, (values (0.5::double), (1.0), (2.0)) h(h)),
sc as (select *, abs(pre - post) / greatest(pre + post, 1e-12) as energy from ls where pre is not null and post is not null)"""

SQL = {
    "q32_union_candidates": DETECTOR_SQL["q20_quiet_basin"].split("\n        select stream_id, l as left_idx")[0]
    + ", qb as (select stream_id, (l + r + 1) * 0.25::double as time_s from (select *, row_number() over (partition by stream_id, l, r order by rms, idx) as n from e where (r - l + 1) * 0.5 <= 1.5) where n = 1),\n"
    + B.SQL["pc"] + ", " + B.SQL["fr"] + ", " + NOVELTY_SQL + ", " + FIXED_SQL
    + """, g as (select no.stream_id, k, no.idx * 0.5::double as time_s, novelty as s from no join ca on ca.stream_id = no.stream_id and candidate_s - no.idx * 0.5::double between 1 and 7),
    gm as (select * from (select *, lag(s) over w as b1, lead(s) over w as n1 from g window w as (partition by stream_id, k order by time_s)) where (b1 is null or s >= b1) and (n1 is null or s >= n1)),
    un as (select qb.stream_id, k, time_s, 0 as o, 'BASIN' as source from qb join ca on ca.stream_id = qb.stream_id and candidate_s - time_s between 1 and 7 union all select stream_id, k, time_s, 1, 'D2' from gm)
    select stream_id, k, round_even(time_s, 3) as time_s, string_agg(distinct source, '+' order by source) as sources from un group by stream_id, k, round_even(time_s, 3)""",
    "q33_family_rrf": "with " + CANDIDATES_SQL + " select stream_id, time_s, d250, d500, d1, d2, mfcc_geo, cast(sr as int) as short_rank, cast(r4 as int) as long_rank, cast(r5 as int) as regime_rank, rrf as family_rrf from rr",
    "q34_minimax": "with " + CANDIDATES_SQL + """, mx as (select *, row_number() over (partition by stream_id order by rrf desc, time_s) as a, row_number() over (partition by stream_id order by forward_novelty desc, time_s) as b from rr)
    select stream_id, time_s, cast(a as int) as rrf_rank, cast(b as int) as novelty_rank from mx qualify row_number() over (partition by stream_id order by greatest(a, b), a + b, a, b, time_s) = 1""",
    "q35_cosine": B.with_sql("ve", PAIR_SQL + " select stream_id, idx, round(" + COS_SQL.format(a="a", b="b") + ", 6) as distance from pa where a is not null"),
    "q36_js_divergence": B.with_sql(
        "ve",
        PAIR_SQL
        + """, m as (select stream_id, idx, list_transform(a, lambda x: abs(x)) as a, list_transform(b, lambda x: abs(x)) as b from pa where a is not null),
    n as (select stream_id, idx, list_transform(a, lambda x: x / list_sum(a)) as p, list_transform(b, lambda x: x / list_sum(b)) as q from m)
    select stream_id, idx, round(least(1, greatest(0, (list_sum(list_transform(list_zip(p, q), lambda z: case when z[1] > 0 then z[1] * log2(z[1] / greatest((z[1] + z[2]) / 2, 1e-18)) else 0 end))
      + list_sum(list_transform(list_zip(p, q), lambda z: case when z[2] > 0 then z[2] * log2(z[2] / greatest((z[1] + z[2]) / 2, 1e-18)) else 0 end))) / 2)), 6) as divergence from n""",
    ),
    "q37_profile_distance": B.with_sql("ve", PAIR_SQL + " select stream_id, idx, round(sqrt(list_sum(list_transform(list_zip(a, b), lambda z: pow(abs(z[1] - z[2]) / greatest(abs(z[1]) + abs(z[2]), 1e-12), 2)))), 6) as distance from pa where a is not null"),
    "q38_robust_normalise": B.with_sql(
        "ve",
        """x as (select stream_id, idx, unnest(vec) as x, cast(generate_subscripts(vec, 1) - 1 as int) as dim from ve),
    q as (select stream_id, dim, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.5) as q2, quantile_cont(x, 0.75) as q3, max(x) - min(x) as sp from x group by all),
    m as (select stream_id, dim, median(abs(x - q2)) as mad from x join q using (stream_id, dim) group by all)
    select stream_id, dim, idx, round((x - q2) / greatest(1.4826 * mad, (q3 - q1) / 1.349, 0.05 * sp, 1e-9), 6) as z from x join q using (stream_id, dim) join m using (stream_id, dim)""",
    ),
    "q39_pairwise_variability": B.with_sql("ve", VARIABILITY_SQL + " select stream_id, bin, round(variability, 6) as variability from bv"),
    "q40_contraction": B.with_sql(
        "ve",
        VARIABILITY_SQL
        + """, n as (select *, floor(count(*) over (partition by stream_id) / 2) as mid, row_number() over (partition by stream_id order by bin) - 1 as n from bv)
    select stream_id, """
        + ", ".join(f"round(avg(case when n >= mid and n < mid + {k} then variability end) / greatest(avg(case when n < mid and n >= mid - {k} then variability end), 1e-9), 6) as ratio_{k}" for k in (1, 2, 3, 5))
        + " from n group by stream_id",
    ),
    "q41_geomean": B.with_sql("lv", "select stream_id, idx // 5 as block, round(exp(avg(ln(greatest(rms, 1e-12)))), 6) as geomean from lv group by all"),
    "q42_regime_ratio": B.with_sql(
        "ve",
        BLOCK_SQL
        + ", w as (select stream_id, block, lag(vec, 2) over o as a, lag(vec) over o as b, vec as c, lead(vec) over o as d from bm window o as (partition by stream_id order by block)) select stream_id, block, round(("
        + COS_SQL.format(a="b", b="c") + ") / greatest(((" + COS_SQL.format(a="a", b="b") + ") + (" + COS_SQL.format(a="c", b="d") + ")) / 2, 1e-9), 6) as ratio from w where a is not null and b is not null and d is not null",
    ),
    "q43_forward_novelty": B.with_sql(
        "ve",
        "pr as (select c.stream_id, c.idx, p.idx as i, min(" + COS_SQL.format(a="p.vec", b="q.vec") + """) as far, count(*) as n from ve c join ve p on p.stream_id = c.stream_id and p.idx between c.idx and c.idx + 3
    join ve q on q.stream_id = c.stream_id and q.idx between c.idx - 4 and c.idx - 1 where c.idx % 4 = 0 group by all)
    select stream_id, idx, round(avg(far), 6) as novelty from pr where n = 4 group by stream_id, idx having count(*) = 4""",
    ),
    "q44_prefix_means": B.with_sql(
        "fr", FIXED_SQL + " select ca.stream_id, k, candidate_s - 4 as from_s, candidate_s as to_s, count(rms) as n, round(avg(rms), 6) as mean_rms from ca left join lv on lv.stream_id = ca.stream_id and start_s + 0.25 >= candidate_s - 4 and start_s + 0.25 < candidate_s group by all"
    ),
    "q45_edge_scan": B.with_sql("lv", SCAN_SQL + " select stream_id, time_s, horizon_s, round(pre, 6) as pre, round(post, 6) as post, round(energy, 6) as energy from sc"),
    "q46_temporal_edge": B.with_sql(
        "fr",
        FIXED_SQL + ", " + SCAN_SQL
        + """, pr as (select stream_id, time_s, min(round(energy, 6)) as least, max(sign(post - pre)) as hi from sc where horizon_s <= 1 group by all
      having count(*) = 2 and min(round(energy, 6)) >= 0.25 and min(sign(post - pre)) = max(sign(post - pre)) and min(sign(post - pre)) <> 0 and max(greatest(pre, post)) >= 0.005)
    select ca.stream_id, k, candidate_s as provisional_s, time_s as edge_s, least as energy, case when hi > 0 then 'RISING' else 'FALLING' end as direction
    from ca join pr on pr.stream_id = ca.stream_id and abs(time_s - candidate_s) <= 2 qualify row_number() over (partition by ca.stream_id, k order by -least, abs(time_s - candidate_s), time_s) = 1""",
    ),
}
