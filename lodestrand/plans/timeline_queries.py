"""Queries over timelines and candidates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.operators import candidates as C
from lodestrand.operators import timeline as T
from lodestrand.sources import bindings as B

INTERVAL = 10.0
TIMES = [12.5, 3.0, 3.0, 40.0, 0.0, 27.25]
EXTERNAL = [(5.0, "manual", None), (5.0, "auto", 7), (5.0, "auto", 7), (12.0, "auto", None), (12.0, "auto", 3), (31.5, "cue", 1), (900.0, "cue", 2)]


def _ends(spark, sf):
    return T.bounds(B.frames(spark, sf))


def _fixed(spark, sf):
    return C.fixed(_ends(spark, sf), INTERVAL)


def _probes(spark, sf):
    """Eight offsets a stream, up to its end."""
    ends = _ends(spark, sf).select("stream_id", "end_offset", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    return ends.select("stream_id", "k", F.floor(F.col("end_offset") * F.col("k") / 7).cast("long").alias("probe"))


ENDS_SQL = """en as (select stream_id, min(time_s) as first_s, max(time_s + samples / sample_rate) as last_end_s, max("offset" + length) as end_offset from fr group by stream_id)"""
FIXED_SQL = ENDS_SQL + ", ca as (select stream_id, k, k * 10.0::double as candidate_s from (select stream_id, unnest(generate_series(1, cast(floor(last_end_s / 10) as bigint))) as k from en))"
PROBES_SQL = ENDS_SQL + ", pr as (select stream_id, cast(k as int) as k, cast(floor(end_offset * k / 7) as bigint) as probe from en, (select unnest(generate_series(0, 7)) as k))"
NEAREST_SQL = "(select arg_min(f.{what}, row(abs(f.time_s - {t}), f.time_s, f.idx)) from fr f where f.stream_id = {a}.stream_id)"
ALIGN_SQL = """al as (select d.*, {i} as i_off, {o} as o_off, en.first_s, en.last_end_s from de d join en using (stream_id)),
sk as (select *, case when incoming_start_s < first_s or incoming_start_s > last_end_s or outgoing_end_s < first_s or outgoing_end_s > last_end_s then 'ERROR'
  when kind = 'HARD_CUT' then 'HARD_CUT' when kind = 'CROSSFADE' and i_off < o_off then 'CROSSFADE'
  when kind = 'EXCLUSION' and i_off = o_off then 'HARD_CUT' when kind = 'EXCLUSION' and o_off < i_off then 'EXCLUSION' else 'ERROR' end as split_kind from al)""".format(
    i=NEAREST_SQL.format(what='"offset"', t="d.incoming_start_s", a="d"), o=NEAREST_SQL.format(what='"offset"', t="d.outgoing_end_s", a="d")
)
OFFSETS_SQL = """split_kind, case when split_kind <> 'ERROR' then i_off end as incoming_offset,
  case when split_kind = 'HARD_CUT' then i_off when split_kind <> 'ERROR' then o_off end as outgoing_offset"""
MINIMA_SQL = """mi as (select stream_id, idx, (start_s + end_s) / 2 as minimum_s, rms from (
  select *, lag(rms) over w as b, lead(rms) over w as a from lv window w as (partition by stream_id order by idx)) where (b is null or rms <= b) and (a is null or rms <= a))"""
MATCH_SQL = MINIMA_SQL + """, pa as (select c.stream_id, c.k, c.candidate_s, m.minimum_s, m.rms, abs(m.minimum_s - c.candidate_s) as gap
  from ca c join mi m on c.stream_id = m.stream_id and abs(m.minimum_s - c.candidate_s) <= 8),
mt as (select stream_id, k, candidate_s, arg_min({'t': minimum_s, 'r': rms}, row(gap, rms, minimum_s)) as s,
  arg_min({'t': minimum_s, 'r': rms}, row(rms, gap, minimum_s)) filter (where minimum_s < candidate_s and gap <= 2) as q from pa group by all),
ch as (select stream_id, k, candidate_s, case when s.t > candidate_s and q is not null and ((q.r = 0 and s.r > 0) or (q.r > 0 and s.r / q.r >= 10)) then q else s end as c from mt),
de as (select stream_id, k, candidate_s, c.t as acoustic_s, c.r as acoustic_rms,
  case when candidate_s - c.t > 3 then 'ACOUSTIC_EARLIER' when candidate_s - c.t < -3 then 'SEMANTIC_EARLIER' else 'AGREEMENT' end as relation,
  case when candidate_s - c.t > 3 then 'CROSSFADE' else 'HARD_CUT' end as kind,
  case when abs(candidate_s - c.t) <= 3 then least(candidate_s, c.t) else c.t end as incoming_start_s,
  case when abs(candidate_s - c.t) <= 3 then least(candidate_s, c.t) when candidate_s - c.t > 3 then candidate_s else c.t end as outgoing_end_s from ch)"""


def q01_resolve_default(spark, sf):
    return C.resolve_default(B.levels(spark, sf), B.frames(spark, sf), _fixed(spark, sf))


def q02_fixed_candidates(spark, sf):
    return _fixed(spark, sf)


def q03_manual_candidates(spark, sf):
    return C.manual(_ends(spark, sf), TIMES)


def q04_external_candidates(spark, sf):
    return C.external(_ends(spark, sf), spark.createDataFrame(EXTERNAL, "time_seconds double, source string, reference_offset int"))


def q07_frame_timeline(spark, sf):
    return T.timeline(B.frames(spark, sf)).select("stream_id", "idx", "offset", "length", F.round("elapsed_s", 6).alias("elapsed_s"))


def _hit(df):
    return df.select("stream_id", "k", "probe", F.col("hit.idx").alias("idx"), F.col("hit.offset").alias("frame_offset"))


def q08_frame_at_or_before(spark, sf):
    return _hit(T.at_or_before(_probes(spark, sf), B.frames(spark, sf), "probe"))


def q09_frame_nearest(spark, sf):
    out = T.nearest(_fixed(spark, sf).withColumn("at_s", F.col("candidate_s") + 0.25), B.frames(spark, sf), "at_s")
    return out.select("stream_id", "k", "at_s", F.col("hit.idx").alias("idx"), F.col("hit.offset").alias("frame_offset"))


def q10_frame_containing(spark, sf):
    return _hit(T.containing(_probes(spark, sf), B.frames(spark, sf), "probe"))


def q11_frame_at_or_after(spark, sf):
    return _hit(T.at_or_after(_probes(spark, sf), B.frames(spark, sf), "probe"))


def q12_split_align(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("HARD_CUT", "CROSSFADE", "EXCLUSION"))), (F.col("k") % 3 + 1).cast("int"))
    shift = F.when(kind == "HARD_CUT", 0.0).when(kind == "CROSSFADE", 1.3).otherwise(-1.3 * (F.col("k") % 2))
    d = _fixed(spark, sf).select("stream_id", "k", kind.alias("kind"), F.col("candidate_s").alias("incoming_start_s"), (F.col("candidate_s") + shift).alias("outgoing_end_s"))
    return T.aligned(d, B.frames(spark, sf))


def q13_window_extract(spark, sf):
    return T.windows(_fixed(spark, sf), B.frames(spark, sf), C.MATCH_RADIUS)


def q29_local_minima(spark, sf):
    return C.local_minima(B.levels(spark, sf))


def q51_settle_filter(spark, sf):
    return T.settled(_fixed(spark, sf), _ends(spark, sf), 8.0)


def q71_ring_retention(spark, sf):
    return T.retained(B.frames(spark, sf), 4096).select("stream_id", "idx", "offset", "length", "ring_start")


QUERIES = {f.__name__: f for f in (q01_resolve_default, q02_fixed_candidates, q03_manual_candidates, q04_external_candidates, q07_frame_timeline, q08_frame_at_or_before, q09_frame_nearest, q10_frame_containing, q11_frame_at_or_after, q12_split_align, q13_window_extract, q29_local_minima, q51_settle_filter, q71_ring_retention)}

SQL = {
    "q01_resolve_default": B.with_sql("fr", f"{FIXED_SQL}, {MATCH_SQL}, {ALIGN_SQL} select stream_id, k, candidate_s, acoustic_s, acoustic_rms, relation, kind, incoming_start_s, outgoing_end_s, {OFFSETS_SQL} from sk"),
    "q02_fixed_candidates": B.with_sql("fr", f"{FIXED_SQL} select * from ca"),
    "q03_manual_candidates": B.with_sql("fr", f"{ENDS_SQL} select stream_id, cast(row_number() over (partition by stream_id order by t) as int) as n, t as candidate_s from en, (select distinct unnest([12.5::double, 3, 3, 40, 0, 27.25]) as t) where t > 0 and t <= last_end_s"),
    "q04_external_candidates": B.with_sql(
        "fr",
        f"""{ENDS_SQL} select stream_id, cast(row_number() over (partition by stream_id order by t, s, coalesce(r, -1)) as int) as n, t as time_seconds, s as source, r as reference_offset
        from en, (values (5.0::double, 'manual', null::int), (5, 'auto', 7), (5, 'auto', 7), (12, 'auto', null), (12, 'auto', 3), (31.5, 'cue', 1), (900, 'cue', 2)) x(t, s, r) where t > 0 and t <= last_end_s""",
    ),
    "q07_frame_timeline": B.with_sql("fr", """select stream_id, idx, "offset", length, round(coalesce(sum(samples / sample_rate) over (partition by stream_id order by idx rows between unbounded preceding and 1 preceding), 0), 6) as elapsed_s from fr"""),
    "q08_frame_at_or_before": B.with_sql(
        "fr",
        f"""{PROBES_SQL} select stream_id, k, probe, coalesce(h.idx, 0) as idx, coalesce(h.o, 0) as frame_offset from (
        select pr.*, (select arg_max({{'idx': f.idx, 'o': f."offset"}}, f."offset") from fr f where f.stream_id = pr.stream_id and f."offset" <= probe) as h from pr)""",
    ),
    "q09_frame_nearest": B.with_sql(
        "fr", f"{FIXED_SQL}, qa as (select *, candidate_s + 0.25 as at_s from ca) select stream_id, k, at_s, {NEAREST_SQL.format(what='idx', t="qa.at_s", a="qa")} as idx, " + NEAREST_SQL.format(what='"offset"', t="qa.at_s", a="qa") + " as frame_offset from qa"
    ),
    "q10_frame_containing": B.with_sql("fr", f"""{PROBES_SQL} select pr.stream_id, pr.k, pr.probe, f.idx, f."offset" as frame_offset from pr left join fr f on f.stream_id = pr.stream_id and f."offset" <= probe and probe < f."offset" + f.length"""),
    "q11_frame_at_or_after": B.with_sql(
        "fr",
        f"""{PROBES_SQL} select stream_id, k, probe, h.idx as idx, h.o as frame_offset from (
        select pr.*, (select arg_min({{'idx': f.idx, 'o': f."offset"}}, f."offset") from fr f where f.stream_id = pr.stream_id and f."offset" + f.length > probe) as h from pr)""",
    ),
    "q12_split_align": B.with_sql(
        "fr",
        f"""{FIXED_SQL}, de as (select stream_id, k, kind, candidate_s as incoming_start_s,
        candidate_s + case kind when 'HARD_CUT' then 0.0::double when 'CROSSFADE' then 1.3::double else -1.3::double * (k % 2) end as outgoing_end_s
        from (select *, case k % 3 when 0 then 'HARD_CUT' when 1 then 'CROSSFADE' else 'EXCLUSION' end as kind from ca)), {ALIGN_SQL}
        select stream_id, k, kind, incoming_start_s, outgoing_end_s, {OFFSETS_SQL} from sk""",
    ),
    "q13_window_extract": B.with_sql(
        "fr",
        f"""{FIXED_SQL}, wi as (select ca.*, {NEAREST_SQL.format(what='idx', t='greatest(0, ca.candidate_s - 8)', a='ca')} as i0,
        (select max(f.idx) from fr f where f.stream_id = ca.stream_id and f.time_s <= ca.candidate_s + 8) as i1 from ca)
        select w.stream_id, w.k, w.candidate_s, a."offset" as start_offset, b."offset" + b.length as end_offset, a.time_s as window_start_s,
        b.time_s + b.samples / b.sample_rate as window_end_s, i1 - i0 + 1 as n_frames
        from wi w join fr a on a.stream_id = w.stream_id and a.idx = i0 join fr b on b.stream_id = w.stream_id and b.idx = i1""",
    ),
    "q29_local_minima": B.with_sql("lv", f"{MINIMA_SQL} select * from mi"),
    "q51_settle_filter": B.with_sql("fr", f"{FIXED_SQL} select ca.* from ca join en using (stream_id) where last_end_s >= candidate_s + 8"),
    "q71_ring_retention": B.with_sql("fr", """select stream_id, idx, "offset", length, ring_start from (select *, cast(greatest(0, sum(length) over (partition by stream_id) - 4096) as bigint) as ring_start from fr) where "offset" + length > ring_start"""),
}
