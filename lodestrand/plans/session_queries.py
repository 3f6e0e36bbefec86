"""Queries over metadata, text, frames and byte ranges, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import text as X
from lodestrand.operators import candidates as C
from lodestrand.operators import output as O
from lodestrand.operators import sessions as S
from lodestrand.operators import timeline as T
from lodestrand.sources import bindings as B
from lodestrand.sources import boundaries as J
from lodestrand.sources import framing as Fr

from .timeline_queries import MINIMA_SQL, ALIGN_SQL, ENDS_SQL, FIXED_SQL, MATCH_SQL, OFFSETS_SQL, _ends, _fixed

LASTING = 21600
SHORT = 10800
POSITIVE, NEGATIVE = ("click", "view"), ("signup",)


def q05_mp3_header(spark, sf):
    rows = B.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.lit(0x7FF << 21) + (F.col("l_partkey") * 40503 + F.col("l_suppkey") * 65537 + F.col("l_orderkey") * 131) % F.lit(1 << 21)).alias("word"))
    return rows.withColumn("h", Fr.mp3_header(F.col("word"))).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "word", "h.*").where("length is not null")


def q06_adts_header(spark, sf):
    high = F.lit(0xFFF00000) + (F.col("l_partkey") * 40503 + F.col("l_orderkey") * 131) % F.lit(1 << 20)
    low = (F.col("l_suppkey") * 65537 + F.col("l_orderkey") * 40503) % F.lit(1 << 24)
    rows = B.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", high.alias("high"), low.alias("low"))
    return rows.withColumn("h", Fr.adts_header(F.col("high"), F.col("low"))).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "high", "low", "h.*").where("length is not null")


def q48_title_lifetime(spark, sf):
    return S.lifetimes(B.titles(spark, sf), LASTING)


def q49_confirm_current(spark, sf):
    return S.confirmed_by_clock(B.titles(spark, sf), LASTING, 7 * 3600)


def q50_transient_exclusion(spark, sf):
    return S.exclusions(S.lifetimes(B.titles(spark, sf), LASTING), SHORT, POSITIVE, NEGATIVE)


def q52_shadow_cadence(spark, sf):
    hypotheses = C.local_minima(B.levels(spark, sf)).select("stream_id", F.col("minimum_s").alias("time_s"))
    ends = B.frames(spark, sf).select("stream_id", (F.col("time_s") + F.col("samples") / F.col("sample_rate")).alias("end_s"))
    return S.shadow_reports(hypotheses, ends, interval=5.0, margin=1.0)


def _splits(spark, sf):
    decided = C.resolve_default(B.levels(spark, sf), B.frames(spark, sf), _fixed(spark, sf)).where("split_kind <> 'ERROR'")
    ends = _ends(spark, sf).select("stream_id", F.lit(0).cast("long").alias("previous_start"), F.col("end_offset").alias("next_end"))
    return decided.select("stream_id", "k", "split_kind", "incoming_offset", "outgoing_offset").join(ends, "stream_id")


def q53_range_plan(spark, sf):
    return O.planned(_splits(spark, sf), crossfade_unowned=True)


def q54_segment_tail(spark, sf):
    decided = C.resolve_default(B.levels(spark, sf), B.frames(spark, sf), _fixed(spark, sf)).where("split_kind <> 'ERROR'")
    rows = decided.select("stream_id", F.col("k").alias("n"), "incoming_offset", "outgoing_offset", "incoming_start_s")
    return O.segments(rows, _ends(spark, sf).select("stream_id", "first_offset", "end_offset", "last_end_s"), 3.0)


def q55_coverage_ledger(spark, sf):
    return O.ledger(B.ranges(spark, sf)).select("stream_id", "seq", "start_offset", "end_offset", "covered", "status")


def q56_terminal_record(spark, sf):
    return O.terminal(O.ledger(B.ranges(spark, sf)))


def _titles(spark, sf):
    """Whole texts as titles."""
    return B.read(spark, sf, "documents").select("doc_id", F.col("text").alias("title"))


def q62_title_normalise(spark, sf):
    return _titles(spark, sf).select("doc_id", X.normal_title(F.col("title")).alias("normal"))


def q63_safe_stem(spark, sf):
    return _titles(spark, sf).select("doc_id", X.safe_stem(F.col("title")).alias("stem"))


def q64_collision_suffix(spark, sf):
    return O.numbered_stems(_titles(spark, sf).select("doc_id", X.safe_stem(F.col("title")).alias("stem")), "stem", "doc_id")


def q65_icy_title(spark, sf):
    block = F.concat(F.lit("StreamTitle='"), F.col("title"), F.lit("';StreamUrl='x';"))
    return _titles(spark, sf).select("doc_id", X.stream_title(F.when(F.col("doc_id") % 7 == 0, F.lit("StreamTitle=' ';")).otherwise(block)).alias("title"))


def q66_swap_title(spark, sf):
    title = F.when(F.col("doc_id") % 3 == 0, F.concat_ws(" - ", "lang", "text")).when(F.col("doc_id") % 3 == 1, F.concat_ws(" - ", "source", "lang", "text")).otherwise(F.col("text"))
    return B.read(spark, sf, "documents").select("doc_id", title.alias("title")).select("doc_id", "title", X.swapped(F.col("title")).alias("swapped"))


def q67_codec_detect(spark, sf):
    f = B.frames(spark, sf)
    codec = F.when((F.col("idx") % 9 < 4) & (F.col("stream_id") % 3 != 0), "mp3").otherwise("aac")
    rate = F.when((F.col("stream_id") % 5 == 0) & (F.col("idx") % 2 == 0), 48000).otherwise(44100)
    return Fr.detected_codec(f.select("stream_id", codec.alias("codec"), "offset", "length", rate.alias("sample_rate")))


def q68_json_boundaries(spark, sf):
    n = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    kind = F.col("event_id") % 6
    text = (
        F.when(kind == 0, F.format_string('{"time_seconds": %d.5, "source": "%s"}', n, "event_type"))
        .when(kind == 1, F.format_string('{"time_seconds": %d, "reference_offset": %d}', n, n))
        .when(kind == 2, F.lit('{"time_seconds": true}'))
        .when(kind == 3, F.lit('{"time_seconds": 1, "source": 5}'))
        .when(kind == 4, F.lit("{broken"))
        .otherwise(F.format_string('{"time_seconds": %d, "reference_offset": null}', n))
    )
    return J.from_lines(B.read(spark, sf, "events").select("event_id", text.alias("value"))).select("event_id", "record.*")


def q69_provenance_json(spark, sf):
    x = O.terminal(O.ledger(B.ranges(spark, sf)))
    return x.select("stream_id", O.provenance([F.col(c) for c in ("complete", "covered_end", "gap_bytes", "n_gaps", "n_ranges")]).alias("record"))


def q70_replay_diff(spark, sf):
    events = B.titles(spark, sf)
    return S.replay_difference(events, events.where((F.col("seq") + F.col("stream_id")) % 41 != 0))


QUERIES = {
    f.__name__: f
    for f in (q05_mp3_header, q06_adts_header, q48_title_lifetime, q49_confirm_current, q50_transient_exclusion, q52_shadow_cadence, q53_range_plan, q54_segment_tail, q55_coverage_ledger, q56_terminal_record, q62_title_normalise, q63_safe_stem, q64_collision_suffix, q65_icy_title, q66_swap_title, q67_codec_detect, q68_json_boundaries, q69_provenance_json, q70_replay_diff)
}

ISLANDS_SQL = """nw as (select *, case when lag(title) over (partition by stream_id order by seq) = title then 0 else 1 end as new from ti),
isl as (select *, cast(sum(new) over (partition by stream_id order by seq) as bigint) as island from nw),
ig as (select stream_id, island, arg_min(title, seq) as title, min(seq) as start_seq, arg_min(t, seq) as start_t from isl group by stream_id, island),
il as (select *, lead(start_t) over (partition by stream_id order by island) as next_t from ig),
li as (select il.stream_id, il.island, il.title, il.start_seq, il.start_t, next_t - start_t as lifetime, case when next_t - start_t >= 21600 then 'HARD_CUT' else 'NO_BOUNDARY' end as kind,
  coalesce((select min(e.t) from isl e where e.stream_id = il.stream_id and e.island = il.island and e.t - start_t >= 21600), case when next_t - start_t >= 21600 then next_t end) as confirmed_t from il where next_t is not null)"""
LEDGER_SQL = """lg as (select *, case when start_offset > covered then 'GAP' when start_offset = covered then 'OK' when end_offset > covered then 'OVERLAP' else 'INSIDE' end as status from (
  select *, coalesce(max(end_offset) over (partition by stream_id order by seq rows between unbounded preceding and 1 preceding), 0) as covered from rg))"""
TERMINAL_SQL = """tm as (select stream_id, count(*) as n_ranges, max(end_offset) as covered_end, count(*) filter (where status = 'GAP') as n_gaps,
  cast(coalesce(sum(start_offset - covered) filter (where status = 'GAP'), 0) as bigint) as gap_bytes, bool_and(status = 'OK') as complete from lg group by stream_id)"""
SPLITS_SQL = f"{FIXED_SQL}, {MATCH_SQL}, {ALIGN_SQL}, sp as (select stream_id, k, incoming_start_s, {OFFSETS_SQL} from sk where split_kind <> 'ERROR')"
TITLE_SQL = "tt as (select doc_id, text as title from documents)"
STEM_SQL = """st as (select doc_id, case when s = '' then 'track' else s end as stem from (
  select doc_id, trim(regexp_replace(regexp_replace(nfc_normalize(title), '[/\\\\:*?"<>|\\x00-\\x1f]', '_', 'g'), '\\s+', ' ', 'g'), ' ._-') as s from tt))"""
MP3_SQL = """with w as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, 4292870144 + (l_partkey * 40503 + l_suppkey * 65537 + l_orderkey * 131) % 2097152 as word from lineitem),
b as (select *, (word >> 19) & 3 as v, (word >> 17) & 3 as l, (word >> 12) & 15 as br, (word >> 10) & 3 as r, (word >> 9) & 1 as p from w),
h as (select *, case when v = 3 then [32,40,48,56,64,80,96,112,128,160,192,224,256,320][br] else [8,16,24,32,40,48,56,64,80,96,112,128,144,160][br] end as kb,
  case v when 3 then [44100,48000,32000][r + 1] when 2 then [22050,24000,16000][r + 1] else [11025,12000,8000][r + 1] end as hz from b where v <> 1 and l = 1 and br not in (0, 15) and r <> 3)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, word, cast((case when v = 3 then 144000 else 72000 end * kb) // hz + p as int) as length, cast(hz as int) as sample_rate, cast(case when v = 3 then 1152 else 576 end as int) as samples
from h where (case when v = 3 then 144000 else 72000 end * kb) // hz + p > 4"""
ADTS_SQL = """with w as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, 4293918720 + (l_partkey * 40503 + l_orderkey * 131) % 1048576 as high, (l_suppkey * 65537 + l_orderkey * 40503) % 16777216 as low from lineitem),
b as (select *, (high >> 16) & 255 as b1, (high >> 10) & 15 as r, ((high & 3) << 11) + ((low >> 13) & 2047) as len from w)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, high, low, cast(len as int) as length, cast([96000,88200,64000,48000,44100,32000,24000,22050,16000,12000,11025,8000,7350][r + 1] as int) as sample_rate, cast(1024 * ((low & 3) + 1) as int) as samples
from b where (high >> 24) & 255 = 255 and b1 & 246 = 240 and r < 13 and len >= case when b1 & 1 = 1 then 7 else 9 end"""

SQL = {
    "q05_mp3_header": MP3_SQL,
    "q06_adts_header": ADTS_SQL,
    "q48_title_lifetime": B.with_sql("ti", ISLANDS_SQL + " select * from li"),
    "q49_confirm_current": B.with_sql(
        "ti",
        ISLANDS_SQL
        + """, e as (select stream_id, max(t) + 25200 as stream_end from ti group by stream_id)
    select il.stream_id, title, start_t, stream_end as confirmed_t from il join e using (stream_id) where next_t is null and stream_end - start_t >= 21600
    and not exists (select 1 from isl where isl.stream_id = il.stream_id and isl.island = il.island and isl.t - il.start_t >= 21600)""",
    ),
    "q50_transient_exclusion": B.with_sql(
        "ti",
        ISLANDS_SQL
        + """, x as (select *, lead(kind) over w as f, lead(start_t) over w as ns from li window w as (partition by stream_id order by island))
    select stream_id, island, title, start_t, start_t + lifetime as end_t, case when f = 'HARD_CUT' and abs(ns - start_t - lifetime) <= 1e-6 then 'EXCLUSION' else 'NO_BOUNDARY' end as kind
    from x where kind = 'NO_BOUNDARY' and lifetime > 0 and lifetime <= 10800 and title in ('click', 'view')""",
    ),
    "q53_range_plan": B.with_sql(
        "fr",
        SPLITS_SQL
        + """, p as (select sp.stream_id, k, split_kind, incoming_offset as i, outgoing_offset as o, 0::bigint as a, end_offset as z from sp join en using (stream_id) where 0 < outgoing_offset and outgoing_offset <= end_offset and 0 <= incoming_offset and incoming_offset < end_offset)
    select stream_id, k, split_kind, i as incoming_offset, o as outgoing_offset, a as previous_start, z as next_end, role, s as start_offset, e as end_offset from (
      select *, 'outgoing' as role, a as s, case when split_kind = 'CROSSFADE' then i else o end as e from p
      union all select *, 'unowned', least(i, o), greatest(i, o) from p where i > o or split_kind = 'CROSSFADE'
      union all select *, 'incoming', case when split_kind = 'CROSSFADE' then o else i end, z from p)""",
    ),
    "q54_segment_tail": B.with_sql(
        "fr",
        SPLITS_SQL
        + """, x as (select sp.*, en.end_offset, last_end_s, coalesce(lag(incoming_offset) over w, 0) as st, lead(k) over w as nx, row_number() over w as n from sp join en using (stream_id) window w as (partition by stream_id order by k)),
    y as (select *, nx is null and greatest(0, last_end_s - incoming_start_s) < 3 as short from x)
    select stream_id, cast(n as int) as index, st as start_offset, case when short then end_offset else outgoing_offset end as end_offset from y
    union all select stream_id, cast(n + 1 as int), incoming_offset, end_offset from y where nx is null and not short""",
    ),
    "q55_coverage_ledger": B.with_sql("rg", LEDGER_SQL + " select stream_id, seq, start_offset, end_offset, covered, status from lg"),
    "q56_terminal_record": B.with_sql("rg", LEDGER_SQL + ", " + TERMINAL_SQL + " select * from tm"),
    "q52_shadow_cadence": B.with_sql(
        "fr",
        MINIMA_SQL
        + """, en as (select stream_id, time_s + samples / sample_rate as e from fr),
    ob as (select stream_id, min(e) as e from en group by stream_id
      union all select o.stream_id, (select min(x.e) from en x where x.stream_id = o.stream_id and x.e - o.e >= 5) from ob o where exists (select 1 from en x where x.stream_id = o.stream_id and x.e - o.e >= 5)),
    tm as (select mi.stream_id, minimum_s as t, (select min(o.e) from ob o where o.stream_id = mi.stream_id and greatest(0, o.e - 3) >= minimum_s) as e from mi),
    ok as (select * from tm where t > 0 and t - greatest(0, e - 120) >= 2 and e - t >= 2),
    gr as (select stream_id, min(t) as t from ok group by stream_id
      union all select g.stream_id, (select min(o.t) from ok o where o.stream_id = g.stream_id and o.t - g.t > 3) from gr g where exists (select 1 from ok o where o.stream_id = g.stream_id and o.t - g.t > 3))
    select ok.stream_id, ok.t as time_s, e as reported_at_s from gr join ok on ok.stream_id = gr.stream_id and ok.t = gr.t""",
        recursive=True,
    ),
    "q62_title_normalise": "with " + TITLE_SQL + " select doc_id, trim(regexp_replace(replace(lower(strip_accents(title)), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')) as normal from tt",
    "q63_safe_stem": "with " + TITLE_SQL + ", " + STEM_SQL + " select doc_id, stem from st",
    "q64_collision_suffix": "with " + TITLE_SQL + ", " + STEM_SQL + " select doc_id, stem, stem || case when n > 1 then '-' || n else '' end as name from (select *, row_number() over (partition by stem order by doc_id) as n from st)",
    "q65_icy_title": "with " + TITLE_SQL + ", b as (select doc_id, case when doc_id % 7 = 0 then 'StreamTitle='' '';' else 'StreamTitle=''' || title || ''';StreamUrl=''x'';' end as b from tt) select doc_id, nullif(trim(split_part(split_part(b, 'StreamTitle=''', 2), ''';', 1), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '') as title from b",
    "q66_swap_title": """with t as (select doc_id, case doc_id % 3 when 0 then concat_ws(' - ', lang, text) when 1 then concat_ws(' - ', source, lang, text) else text end as title from documents),
    p as (select *, string_split(title, ' - ') as p from t)
    select doc_id, title, case when len(p) = 2 and trim(p[1], ' ') <> '' and trim(p[2], ' ') <> '' then trim(p[2], ' ') || ' - ' || trim(p[1], ' ') else title end as swapped from p""",
    "q67_codec_detect": B.with_sql(
        "fr",
        """c as (select stream_id, case when idx % 9 < 4 and stream_id % 3 <> 0 then 'mp3' else 'aac' end as codec, "offset", length, case when stream_id % 5 = 0 and idx % 2 = 0 then 48000 else 44100 end as rate from fr),
    n as (select *, case when lag("offset" + length) over w = "offset" and lag(rate) over w = rate then 0 else 1 end as new from c window w as (partition by stream_id, codec order by "offset")),
    r as (select *, sum(new) over (partition by stream_id, codec order by "offset") as run from n), g as (select stream_id, codec, run, count(*) as n from r group by all), k as (select stream_id, codec, max(n) >= 3 as ok from g group by all)
    select stream_id, case when count(*) filter (where ok) = 1 then max(codec) filter (where ok) end as codec from k group by stream_id""",
    ),
    "q68_json_boundaries": """with n as (select event_id, event_id % 6 as k, cast(regexp_extract(props, '(\\d+)', 1) as int) as n, event_type from events)
    select event_id, case k when 0 then n + 0.5::double when 1 then n when 5 then n end as time_seconds, case k when 0 then event_type when 1 then 'external' when 5 then 'external' end as source, case k when 1 then cast(n as bigint) end as reference_offset from n""",
    "q69_provenance_json": B.with_sql(
        "rg", LEDGER_SQL + ", " + TERMINAL_SQL + """ select stream_id, '{"complete":' || complete || ',"covered_end":' || covered_end || ',"gap_bytes":' || gap_bytes || ',"n_gaps":' || n_gaps || ',"n_ranges":' || n_ranges || '}' as record from tm"""
    ),
    "q70_replay_diff": B.with_sql(
        "ti",
        """a as (select stream_id, row_number() over (partition by stream_id order by seq) - 1 as pos, title, t from ti),
    b as (select stream_id, row_number() over (partition by stream_id order by seq) - 1 as pos, title, t from ti where (seq + stream_id) % 41 <> 0)
    select coalesce(a.stream_id, b.stream_id) as stream_id, count(a.t) as n_captured, count(b.t) as n_replayed, min(case when a.title is distinct from b.title or a.t is distinct from b.t then coalesce(a.pos, b.pos) end) as first_difference
    from a full join b on a.stream_id = b.stream_id and a.pos = b.pos group by 1""",
    ),
}
