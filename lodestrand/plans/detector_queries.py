"""Queries over envelopes and samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.operators import detect as D
from lodestrand.sources import bindings as B

from .fade_sql import BASINS, INCOMING, OUTGOING, PAIRS, SMOOTH
from .timeline_queries import FIXED_SQL, _fixed

BASIN = {"base": 6, "recovery": 3, "longest": 20, "start_ratio": 0.5, "hold": 0.7, "back": 0.5, "rise": 2.0}
ATTACK = {"base": 4, "stable": 0.1, "quiet": 0.8, "jump": 1.5, "hold": 1.0}


def _features(spark, sf):
    return D.structural_features(B.pcm(spark, sf), 5)


def _round(df, *names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def q14_rms_profile(spark, sf):
    return _round(D.rms_levels(B.pcm(spark, sf), 5, whole=False), "rms")


def q15_basin_levels(spark, sf):
    return _round(D.rms_levels(B.pcm(spark, sf), 4, whole=True), "rms")


def q16_structural_features(spark, sf):
    return _round(_features(spark, sf), "rms", "zcr", "mean_abs_delta", "crest")


def q17_structural_novelty(spark, sf):
    return _round(D.novelty(_features(spark, sf), 3), "novelty")


def q18_peak_spacing(spark, sf):
    return D.spaced_peaks(_round(D.novelty(_features(spark, sf), 3), "novelty"), 0.12, 3.0, 0.5)


def q19_adaptive_basin(spark, sf):
    return D.adaptive_basins(B.levels(spark, sf), **BASIN)


def q20_quiet_basin(spark, sf):
    return _round(D.quiet_basins(B.levels(spark, sf)), "prominence", "quietness")


def q21_energy_rise(spark, sf):
    return _round(D.energy_rises(B.levels(spark, sf)), "jump", "persistence", "level_ratio")


def q22_moving_median(spark, sf):
    return D.moving_median(B.levels(spark, sf)).select("stream_id", "idx", "rms", "smooth")


def q23_monotonicity(spark, sf):
    return D.monotonicity(B.levels(spark, sf), 8)


def _outgoing(spark, sf):
    levels = B.levels(spark, sf)
    return D.with_rise(D.outgoing_fades(levels), D.energy_rises(levels))


def q24_outgoing_fades(spark, sf):
    return _round(_outgoing(spark, sf), "descent_ratio", "descent_consistency")


def q25_incoming_fades(spark, sf):
    return _round(D.incoming_fades(B.levels(spark, sf)), "ascent_ratio", "ascent_consistency", "persistence_ratio", digits=9)


def q26_fade_pairs(spark, sf):
    return D.fade_pairs(_outgoing(spark, sf), D.incoming_fades(B.levels(spark, sf)))


def q27_autonomous(spark, sf):
    found = D.attacks(B.levels(spark, sf), **ATTACK)
    return D.spaced(_round(found, "basin", "attack", "persistence"), 5.0, "attack_s")


def q28_mp3_refine(spark, sf):
    current = _fixed(spark, sf).select("stream_id", "k", F.col("candidate_s").alias("current_s"))
    return D.refined(B.levels(spark, sf), current, quiet=0.9, jump=1.5, hold=1.0)


def q47_silence_gap(spark, sf):
    reference = _fixed(spark, sf).select("stream_id", "k", F.col("candidate_s").alias("reference_s"))
    return D.silence_gaps(B.levels(spark, sf), reference, quiet=30.0, shortest=0.5, longest=3.0, radius=4.0, flank=1, loud=35.0)


QUERIES = {
    f.__name__: f
    for f in (q14_rms_profile, q15_basin_levels, q16_structural_features, q17_structural_novelty, q18_peak_spacing, q19_adaptive_basin, q20_quiet_basin, q21_energy_rise, q22_moving_median, q23_monotonicity, q24_outgoing_fades, q25_incoming_fades, q26_fade_pairs, q27_autonomous, q28_mp3_refine, q47_silence_gap)
}

FEATURES_SQL = """fe as (select stream_id, idx, rms, crossings / greatest(1, n - 1) as zcr, mean_abs_delta, peak / greatest(rms, 1e-9::double) as crest from (
  select stream_id, idx, count(*) as n, sqrt(avg(cast(sample as double) * sample)) / 32768 as rms,
    sum(case when ("left" < 0 and sample >= 0) or ("left" >= 0 and sample < 0) then 1 else 0 end)::double as crossings,
    avg(abs(sample - "left")) / 65535 as mean_abs_delta, max(abs(sample)) / 32768 as peak
  from (select stream_id, i // 5 as idx, i, sample, lag(sample) over (partition by stream_id, i // 5 order by i) as "left" from pc) group by all) where n >= 2)"""
NOVELTY_SQL = FEATURES_SQL + """, no as (select stream_id, idx, round(sqrt((a1 - b1) ** 2 + (a2 - b2) ** 2 + (a3 - b3) ** 2 + ((a4 - b4) / 4) ** 2), 6) as novelty from (
  select stream_id, idx, count(*) over b as nb, count(*) over a as na, avg(rms) over b as b1, avg(rms) over a as a1, avg(zcr) over b as b2, avg(zcr) over a as a2,
    avg(mean_abs_delta) over b as b3, avg(mean_abs_delta) over a as a3, avg(crest) over b as b4, avg(crest) over a as a4 from fe
  window b as (partition by stream_id order by idx rows between 3 preceding and 1 preceding), a as (partition by stream_id order by idx rows between current row and 2 following)) where nb = 3 and na = 3)"""

SQL = {
    "q14_rms_profile": B.with_sql("pc", "select stream_id, i // 5 as idx, round(sqrt(avg(cast(sample as double) * sample)), 6) as rms, count(*) as n from pc group by all"),
    "q15_basin_levels": B.with_sql("pc", "select stream_id, i // 4 as idx, round(sqrt(avg(cast(sample as double) * sample)), 6) as rms, count(*) as n from pc group by all having count(*) = 4"),
    "q16_structural_features": B.with_sql("pc", FEATURES_SQL + " select stream_id, idx, round(rms, 6) as rms, round(zcr, 6) as zcr, round(mean_abs_delta, 6) as mean_abs_delta, round(crest, 6) as crest from fe"),
    "q17_structural_novelty": B.with_sql("pc", NOVELTY_SQL + " select * from no"),
    "q18_peak_spacing": B.with_sql(
        "pc",
        NOVELTY_SQL
        + """, pk as (select stream_id, idx * 0.5::double as t, novelty as s, row_number() over (partition by stream_id order by idx) as n from (
        select *, lag(novelty) over w as b, lead(novelty) over w as a from no window w as (partition by stream_id order by idx))
        where novelty >= 0.12 and (b is null or novelty >= b) and (a is null or novelty >= a)),
        wk as (select stream_id, n, t, least(1, s) as s, 1 as seg from pk where n = 1
        union all select p.stream_id, p.n, case when p.t - w.t >= 3 or p.s > w.s then p.t else w.t end, case when p.t - w.t >= 3 or p.s > w.s then least(1, p.s) else w.s end, w.seg + case when p.t - w.t >= 3 then 1 else 0 end
        from wk w join pk p on p.stream_id = w.stream_id and p.n = w.n + 1)
        select stream_id, arg_max(t, n) as time_s, arg_max(s, n) as strength from wk group by stream_id, seg""",
        recursive=True,
    ),
    "q19_adaptive_basin": B.with_sql(
        "lv",
        BASINS + " select k.stream_id, k.idx as start_idx, m as minimum_idx, r as recovery_idx, base as baseline, low as minimum_rms, low / greatest(base, 1e-12::double) as depth from bk k join bg on bg.stream_id = k.stream_id and bg.i = k.idx",
        recursive=True,
    ),
    "q24_outgoing_fades": B.with_sql(
        "lv",
        OUTGOING + " select * replace (round(descent_ratio, 6) as descent_ratio, round(descent_consistency, 6) as descent_consistency) from og",
        recursive=True,
    ),
    "q25_incoming_fades": B.with_sql(
        "lv",
        SMOOTH + ", " + INCOMING + " select * replace (round(ascent_ratio, 9) as ascent_ratio, round(ascent_consistency, 9) as ascent_consistency, round(persistence_ratio, 9) as persistence_ratio) from ig",
        recursive=True,
    ),
    "q26_fade_pairs": B.with_sql(
        "lv",
        OUTGOING + ", " + INCOMING + ", " + PAIRS
        + " select *, incoming_start_s - floor_s as separation_s, greatest(0.0::double, floor_s - incoming_start_s) as overlap_s, greatest(0.0::double, incoming_start_s - floor_s) as gap_s from fp",
        recursive=True,
    ),
    "q20_quiet_basin": B.with_sql(
        "lv",
        """x as (select *, lag(rms) over w as b, lead(rms) over w as a, median(rms) over (partition by stream_id) as overall, median(rms) over (partition by stream_id order by idx rows between 6 preceding and 6 following) as around
        from lv window w as (partition by stream_id order by idx)),
        m as (select * from x where overall > 0 and (b is null or rms <= b) and (a is null or rms <= a)),
        e as (select m.*, coalesce((select max(v.idx) from lv v where v.stream_id = m.stream_id and v.idx < m.idx and v.rms > m.rms * 1.4::double), -1) + 1 as l,
        coalesce((select min(v.idx) from lv v where v.stream_id = m.stream_id and v.idx > m.idx and v.rms > m.rms * 1.4::double), (select max(v.idx) + 1 from lv v where v.stream_id = m.stream_id)) - 1 as r from m)
        select stream_id, l as left_idx, r as right_idx, (l + r + 1) * 0.25::double as center_s, (r - l + 1) * 0.5::double as width_s, rms as minimum_rms, round(around / greatest(rms, 1e-9::double), 6) as prominence, round(overall / greatest(rms, 1e-9::double), 6) as quietness
        from (select *, row_number() over (partition by stream_id, l, r order by rms, idx) as n from e where (r - l + 1) * 0.5 <= 1.5) where n = 1""",
    ),
    "q21_energy_rise": B.with_sql(
        "lv",
        """x as (select *, avg(rms) over (partition by stream_id order by idx rows between 3 preceding and 1 preceding) as b, avg(rms) over (partition by stream_id order by idx rows between current row and 2 following) as a,
        avg(rms) over (partition by stream_id order by idx rows between current row and 9 following) as l, median(rms) over (partition by stream_id) as m, count(*) over (partition by stream_id) as n from lv),
        y as (select stream_id, idx, start_s as rise_s, a / greatest(b, 1e-9) as jump, l / greatest(b, 1e-9) as persistence, a / greatest(m, 1e-9) as level_ratio from x where idx >= 3 and idx < n - 10)
        select stream_id, idx, rise_s, round(jump, 6) as jump, round(persistence, 6) as persistence, round(level_ratio, 6) as level_ratio from y where jump >= 2.5 and persistence >= 3 and level_ratio >= 2.5""",
    ),
    "q22_moving_median": B.with_sql("lv", "select stream_id, idx, rms, median(rms) over (partition by stream_id order by idx rows between 1 preceding and 1 following) as smooth from lv"),
    "q23_monotonicity": B.with_sql(
        "lv",
        """s as (select *, idx // 8 as block, median(rms) over (partition by stream_id order by idx rows between 1 preceding and 1 following) as smooth from lv),
        p as (select *, lag(smooth) over w as ps, lag(rms) over w as pr from s window w as (partition by stream_id, block order by idx))
        select stream_id, block, round(avg(case when pr is not null then case when smooth <= ps then 1.0::double else 0 end end), 9) as falling, round(avg(case when pr is not null then case when rms >= pr then 1.0::double else 0 end end), 9) as rising from p group by all""",
    ),
    "q27_autonomous": B.with_sql(
        "lv",
        """x as (select *, median(rms) over b as bl, min(rms) over b as lo, max(rms) over b as hi, avg(rms) over (partition by stream_id order by idx rows between 2 preceding and 1 preceding) as ba,
        avg(rms) over (partition by stream_id order by idx rows between current row and 1 following) as ak, median(rms) over (partition by stream_id order by idx rows between 2 following and 7 following) as pe, count(*) over (partition by stream_id) as n
        from lv window b as (partition by stream_id order by idx rows between 6 preceding and 3 preceding)),
        f as (select stream_id, idx, start_s as attack_s, round(ba, 6) as basin, round(ak, 6) as attack, round(pe, 6) as persistence from x
        where idx >= 6 and idx + 8 <= n and n > 12 and bl > 0 and hi > 0 and lo / hi >= 0.1 and ba / bl <= 0.8 and ak / greatest(ba, 1e-9) >= 1.5 and pe / greatest(ba, 1e-9) >= 1.0),
        w as (select stream_id, min(attack_s) as t from f group by stream_id union all
        select w.stream_id, (select min(f.attack_s) from f where f.stream_id = w.stream_id and f.attack_s - w.t >= 5) from w where exists (select 1 from f where f.stream_id = w.stream_id and f.attack_s - w.t >= 5))
        select f.* from f join w on f.stream_id = w.stream_id and f.attack_s = w.t""",
        recursive=True,
    ),
    "q28_mp3_refine": B.with_sql(
        "fr",
        FIXED_SQL
        + """, x as (select *, avg(rms) over (partition by stream_id order by idx rows between 2 preceding and 1 preceding) as ba, avg(rms) over (partition by stream_id order by idx rows between current row and 1 following) as nw,
        avg(rms) over (partition by stream_id order by idx rows between current row and 5 following) as lo, count(*) over (partition by stream_id) as n from lv),
        md as (select c.stream_id, c.k, c.candidate_s, median(rms) as m, max(rms) as t from ca c join lv on lv.stream_id = c.stream_id and abs(start_s - candidate_s) <= 1.25 group by all),
        mm as (select stream_id, k, candidate_s, case when m > 0 then m else t end as m from md where (case when m > 0 then m else t end) > 0),
        h as (select mm.*, arg_min(x.idx, row(abs(start_s - candidate_s), -(nw / greatest(ba, 1e-9)), -(lo / greatest(ba, 1e-9)), x.idx)) as ai from mm join x on x.stream_id = mm.stream_id and abs(start_s - candidate_s) <= 1.5
        where x.idx >= 2 and x.idx < n - 6 and ba / m <= 0.9 and nw / greatest(ba, 1e-9) >= 1.5 and lo / greatest(ba, 1e-9) >= 1.0 group by mm.stream_id, mm.k, mm.candidate_s, mm.m),
        wk as (select h.*, coalesce((select max(v.idx) from lv v where v.stream_id = h.stream_id and v.idx < ai and v.rms > m * 0.9::double), -1) + 1 as f0 from h),
        g as (select stream_id, k, case when f0 = ai then greatest(0, ai - 2) else f0 end * 0.5::double as b, ai * 0.5::double as a from wk),
        o as (select ca.stream_id, ca.k, candidate_s as c, b, a, (a + b) / 2 as mid from ca left join g using (stream_id, k))
        select stream_id, k, c as current_s, b as basin_start_s, a as attack_s, mid as mid_s,
        case when a is null or a - b > 3 then c when a - c <= 0.10::double then case when a - b > 1 then c else greatest(0, b - 0.20::double) end when b - c > 0 and mid - c > 0.30::double then c else mid end as boundary_s from o""",
    ),
    "q47_silence_gap": B.with_sql(
        "fr",
        FIXED_SQL
        + """, x as (select *, rms < 30 as quiet, count(*) over (partition by stream_id) as n, lag(rms) over w as before, lead(rms) over w as after from lv window w as (partition by stream_id order by idx)),
        i as (select stream_id, idx - row_number() over (partition by stream_id order by idx) as g, n, idx, before, after from x where quiet),
        isl as (select stream_id, n, min(idx) as a, max(idx) + 1 as b, arg_min(before, idx) as be, arg_max(after, idx) as af from i group by stream_id, g, n),
        ok as (select stream_id, a * 0.5::double as l, b * 0.5::double as r from isl where (b - a) * 0.5 between 0.5 and 3 and a >= 1 and b + 1 <= n and be >= 35 and af >= 35)
        select ca.stream_id, k, candidate_s as reference_s, min(l) as outgoing_end_s, min(r) as incoming_start_s from ca join ok on ok.stream_id = ca.stream_id and greatest(abs(l - candidate_s), abs(r - candidate_s)) <= 4
        group by all having count(*) = 1""",
    ),
}
