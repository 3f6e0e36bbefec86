"""Queries over bytes, spools, and state along streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.operators import output as O
from lodestrand.operators import spans as S
from lodestrand.operators import timeline as T
from lodestrand.operators import tracks as K
from lodestrand.sources import bindings as B

from .timeline_queries import ENDS_SQL, FIXED_SQL, _ends, _fixed

SIZE, PIECE = 256, 100


def _texts(spark, sf):
    return B.read(spark, sf, "documents").select(F.col("doc_id").alias("stream_id"), F.encode("text", "UTF-8").alias("data"))


def _pieces(spark, sf):
    """Texts' bytes in pieces of 700."""
    x = _texts(spark, sf).where(F.octet_length("data") > 0).select("stream_id", "data", F.explode(F.expr("sequence(0L, octet_length(data) - 1, 700L)")).alias("start_offset"))
    return x.select("stream_id", "start_offset", F.expr("substring(data, cast(start_offset as int) + 1, 700)").alias("data"))


def q84_spool(spark, sf):
    chunks = S.spooled(_pieces(spark, sf), SIZE)
    return chunks.select("stream_id", "chunk", "start_offset", F.octet_length("data").cast("long").alias("n_bytes"), F.md5("data").alias("digest"))


def q85_spool_retention(spark, sf):
    """What is left when each stream's first half is discarded."""
    chunks = S.spooled(_pieces(spark, sf), SIZE)
    starts = _texts(spark, sf).select("stream_id", F.floor(F.octet_length("data") / 2).cast("long").alias("start"))
    return S.inventory(S.discarded(chunks, starts))


def q86_range_read(spark, sf):
    """Two ranges of each stream, of which the second begins before what is retained in every third stream."""
    chunks = S.spooled(_pieces(spark, sf), SIZE).where((F.col("stream_id") % 3 != 0) | (F.col("chunk") > 0))
    n = F.octet_length("data").cast("long")
    a = F.array(F.struct(F.lit(0).alias("range"), F.floor(n / 4).cast("long").alias("start_offset"), F.floor(n / 2).cast("long").alias("end_offset")), F.struct(F.lit(1).alias("range"), F.floor(n / 8).cast("long").alias("start_offset"), F.least(n, F.floor(n / 8) + 333).cast("long").alias("end_offset")))
    ranges = _texts(spark, sf).where(n >= 8).select("stream_id", F.explode(a).alias("r")).select("stream_id", "r.*")
    return S.read(chunks, ranges, PIECE, SIZE).select("stream_id", "range", "piece", "at", F.md5("data").alias("digest"))


def q87_coverage_final(spark, sf):
    ledger = O.ledger(B.ranges(spark, sf))
    spools = ledger.groupBy("stream_id").agg(F.lit(0).cast("long").alias("spool_start"), (F.max("end_offset") + F.when(F.col("stream_id") % 2 == 0, 64).otherwise(0)).alias("spool_end"))
    return S.finalized(ledger, spools)


def q88_write_guards(spark, sf):
    x = B.read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), (F.col("l_quantity").cast("long") * 97).alias("size"), (F.lit(512 << 20) + F.col("l_partkey")).cast("long").alias("free_bytes"),
        F.when(F.col("l_returnflag") == "R", "mp3").otherwise("aac").alias("codec"), F.when(F.col("l_linestatus") == "O", "unowned").otherwise("outgoing").alias("role"),
    )
    return S.guards(x, most=4500).groupBy("codec", "role", "allowed", "kept_raw").agg(F.count(F.lit(1)).alias("n"), F.sum("needed_bytes").alias("needed"), F.max("timeout_s").alias("timeout_s"))


def q89_row_constraints(spark, sf):
    t = F.col("rms")
    kind = F.element_at(F.array(*map(F.lit, ("HARD_CUT", "CROSSFADE", "EXCLUSION", "OTHER"))), (F.col("idx") % 4 + 1).cast("int"))
    x = B.levels(spark, sf).select("stream_id", "idx", kind.alias("kind"), (t - 20).alias("incoming_start_s"), F.when(F.col("idx") % 3 == 0, t - 20).otherwise(F.col("start_s")).alias("outgoing_end_s"))
    return x.select("stream_id", "idx", F.array_join(S.violations(), "+").alias("broken"))


def _offsets(spark, sf):
    """Each stream's frames as transitions: what ends at a frame's offset, and what begins some bytes before or after."""
    f = B.frames(spark, sf)
    return f.select("stream_id", F.col("idx").alias("n"), F.col("offset").alias("outgoing_end"), (F.col("offset") + F.col("length") * (F.col("idx") % 5 - 2)).alias("incoming_start"))


def q90_writable_transitions(spark, sf):
    return K.written(_offsets(spark, sf))


def q91_autonomous_segments(spark, sf):
    x = B.levels(spark, sf).select("stream_id", F.col("idx").alias("n"), F.col("start_s").alias("time_s"), F.when(F.col("rms") > 25, "HIGH").otherwise("UNRESOLVED").alias("confidence"))
    return K.autonomous(x, 3.0)


def q92_track_transitions(spark, sf):
    x = B.levels(spark, sf).select("stream_id", F.col("idx").alias("n"), F.when(F.col("rms") > 3, F.col("start_s")).alias("boundary_s"))
    return K.track_transitions(x)


def q93_stale_transitions(spark, sf):
    x = _offsets(spark, sf).select("stream_id", "n", (F.col("incoming_start") - 40).alias("open_start"), (F.col("outgoing_end") + 15).alias("incoming_offset"))
    return K.stale(x, B.frames(spark, sf))


def q94_metadata_times(spark, sf):
    x = B.titles(spark, sf).select("stream_id", "seq", F.col("seq").alias("idx"), (F.col("seq") * 37).alias("audio_offset"))
    return K.timed(x, B.frames(spark, sf)).select("stream_id", "seq", "audio_offset", "time_s")


def q95_provider_cursor(spark, sf):
    ends = B.frames(spark, sf).where("idx % 7 = 6").select("stream_id", F.col("idx").alias("batch"), (F.col("time_s") + 0.5).alias("end_s"))
    return K.proposed_until(_fixed(spark, sf), ends)


def q96_promoted(spark, sf):
    x = B.levels(spark, sf).select("stream_id", F.col("idx").alias("hyp_id"), (F.col("start_s") + 0.3).alias("time_s"), F.when(F.col("rms") > 40, "HIGH").otherwise("UNRESOLVED").alias("confidence"))
    return K.promoted(x, B.frames(spark, sf)).select("stream_id", "hyp_id", "split_kind", "incoming_offset", "outgoing_offset")


def q97_scan_times(spark, sf):
    x = _fixed(spark, sf).select("stream_id", F.col("k").alias("n"), (F.col("candidate_s") - F.when(F.col("k") % 2 == 0, 9.7).otherwise(0)).alias("anchor_s"))
    return K.scan_times(x, 2.0, 0.1)


def q98_search_bounds(spark, sf):
    x = B.levels(spark, sf).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.when(F.col("rms") < 20, F.floor("rms") * 0.5).alias("t")))).alias("s"))
    x = x.select("stream_id", K.search_bounds("transform(s, e -> e.t)").alias("b")).where("b is not null")
    return x.select("stream_id", F.size("b.times").alias("n_times"), F.col("b.start_s"), F.col("b.end_s"), F.get("b.times", F.lit(0)).alias("first_time"))


QUERIES = {
    f.__name__: f
    for f in (q84_spool, q85_spool_retention, q86_range_read, q87_coverage_final, q88_write_guards, q89_row_constraints, q90_writable_transitions, q91_autonomous_segments, q92_track_transitions, q93_stale_transitions, q94_metadata_times, q95_provider_cursor, q96_promoted, q97_scan_times, q98_search_bounds)
}

BYTES_SQL = "tb as (select doc_id as stream_id, encode(text) as data, octet_length(encode(text)) as n from documents)"
CHUNKS_SQL = BYTES_SQL + ", ck as (select stream_id, n, data, unnest(generate_series(0, (n - 1) // 256)) as chunk from tb where n > 0)"
AFTER_SQL = '(select arg_min({what}, f.idx) from fr f where f.stream_id = x.stream_id and f."offset" + f.length > x.{at})'

SQL = {
    "q84_spool": "with " + CHUNKS_SQL + " select stream_id, chunk, chunk * 256 as start_offset, least(256, n - chunk * 256) as n_bytes, md5(data[chunk * 256 + 1 : chunk * 256 + 256]) as digest from ck",
    "q85_spool_retention": "with " + CHUNKS_SQL + " select stream_id, count(*) as n_chunks, min(chunk) * 256 as start_offset, max(n) as end_offset, true as contiguous from ck where least(n, (chunk + 1) * 256) > n // 2 group by stream_id",
    "q86_range_read": "with " + BYTES_SQL
    + """, rr as (select stream_id, data, n, 0 as range, n // 4 as a, n // 2 as z from tb where n >= 8 union all select stream_id, data, n, 1, n // 8, least(n, n // 8 + 333) from tb where n >= 8),
    pp as (select *, unnest(generate_series(0, (z - a - 1) // 100)) as piece from rr where z > a)
    select stream_id, range, piece, a + piece * 100 as at, case when stream_id % 3 <> 0 or a + piece * 100 >= 256 then md5(data[a + piece * 100 + 1 : least(z, a + piece * 100 + 100)]) end as digest from pp""",
    "q87_coverage_final": B.with_sql(
        "rg",
        """lg as (select *, coalesce(max(end_offset) over (partition by stream_id order by seq rows between unbounded preceding and 1 preceding), 0) as covered from rg),
    a as (select stream_id, max(end_offset) as c, count(*) filter (where start_offset > covered) as holes, min(start_offset) as b, max(end_offset) + case when stream_id % 2 = 0 then 64 else 0 end as e from lg group by stream_id)
    select stream_id, case when holes > 0 or b <> 0 then 'ERROR' when c = e then 'COMPLETE' else 'TAIL' end as status, case when holes = 0 and b = 0 and c < e then c end as tail_start, case when holes = 0 and b = 0 and c < e then e end as tail_end from a""",
    ),
    "q88_write_guards": """with x as (select cast(l_quantity as bigint) * 97 as size, 536870912 + l_partkey as free, case when l_returnflag = 'R' then 'mp3' else 'aac' end as codec, case when l_linestatus = 'O' then 'unowned' else 'outgoing' end as role from lineitem),
    y as (select *, 536870912 + cast(ceil(size * 1.25::double) as bigint) as need from x)
    select codec, role, size <= 4500 and free >= need as allowed, role = 'unowned' and codec = 'mp3' and size < 4096 as kept_raw, count(*) as n, cast(sum(need) as bigint) as needed, max(greatest(30.0::double, size / 8388608)) as timeout_s from y group by all""",
    "q89_row_constraints": B.with_sql(
        "lv",
        """x as (select stream_id, idx, case idx % 4 when 0 then 'HARD_CUT' when 1 then 'CROSSFADE' when 2 then 'EXCLUSION' else 'OTHER' end as kind, rms - 20 as i, case when idx % 3 = 0 then rms - 20 else start_s end as o from lv)
    select stream_id, idx, concat_ws('+', case when kind = 'OTHER' then 'unknown kind' end, case when i < 0 or o < 0 then 'time below zero' end, case when kind = 'HARD_CUT' and i <> o then 'cut with two times' end,
      case when kind = 'CROSSFADE' and i >= o then 'crossfade without overlap' end, case when kind = 'EXCLUSION' and o >= i then 'exclusion without gap' end) as broken from x""",
    ),
    "q90_writable_transitions": B.with_sql(
        "fr",
        """x as (select stream_id, idx as n, "offset" as o, "offset" + length * (idx % 5 - 2) as i from fr),
    w as (select stream_id, min(n) as n from x group by stream_id union all
      select w.stream_id, (select min(y.n) from x y where y.stream_id = w.stream_id and y.n > w.n and y.o > c.i and y.i > c.i) from w join x c on c.stream_id = w.stream_id and c.n = w.n
      where exists (select 1 from x y where y.stream_id = w.stream_id and y.n > w.n and y.o > c.i and y.i > c.i))
    select x.stream_id, x.n, lag(x.i) over (partition by x.stream_id order by x.n) as open_start, x.o as outgoing_end, x.i as incoming_start from x join w on w.stream_id = x.stream_id and w.n = x.n""",
        recursive=True,
    ),
    "q91_autonomous_segments": B.with_sql(
        "lv",
        """x as (select stream_id, idx as n, start_s as t from lv where rms > 25),
    w as (select stream_id, min(n) as n from x group by stream_id union all
      select w.stream_id, (select min(y.n) from x y where y.stream_id = w.stream_id and y.t - c.t >= 3) from w join x c on c.stream_id = w.stream_id and c.n = w.n where exists (select 1 from x y where y.stream_id = w.stream_id and y.t - c.t >= 3)),
    s as (select x.stream_id, x.n, lag(x.t) over (partition by x.stream_id order by x.n) as start_s, x.t as time_s from x join w on w.stream_id = x.stream_id and w.n = x.n)
    select * from s where start_s is not null""",
        recursive=True,
    ),
    "q92_track_transitions": B.with_sql(
        "lv",
        """b as (select stream_id, min(idx) as stop from lv where idx > 0 and rms <= 3 group by stream_id)
    select lv.stream_id, idx - 1 as outgoing_n, idx as incoming_n, start_s as boundary_s from lv left join b on b.stream_id = lv.stream_id where idx > 0 and idx < coalesce(stop, 1e9)""",
    ),
    "q93_stale_transitions": B.with_sql(
        "fr",
        """x as (select stream_id, idx as n, "offset" + length * (idx % 5 - 2) - 40 as open_start, "offset" + 15 as incoming_offset from fr),
    y as (select x.*, """ + AFTER_SQL.format(what="{'t': f.time_s, 'o': f.\"offset\"}", at="incoming_offset") + """ as h from x)
    select stream_id, n, open_start, incoming_offset, case when h.o > open_start then h.t end as cut_s, case when h.o > open_start then h.o end as cut_offset from y""",
    ),
    "q94_metadata_times": B.with_sql("fr ti", "x as (select stream_id, seq, seq * 37 as audio_offset from ti) select stream_id, seq, audio_offset, " + AFTER_SQL.format(what="f.time_s", at="audio_offset") + " as time_s from x"),
    "q95_provider_cursor": B.with_sql(
        "fr",
        FIXED_SQL + " select ca.*, (select min(f.idx) from fr f where f.stream_id = ca.stream_id and f.idx % 7 = 6 and f.time_s + 0.5::double >= ca.candidate_s) as batch from ca",
    ),
    "q96_promoted": B.with_sql(
        "fr",
        ENDS_SQL
        + """, x as (select lv.stream_id, idx as hyp_id, start_s + 0.3::double as t from lv where rms > 40),
    y as (select x.*, (select arg_min(f."offset", row(abs(f.time_s - x.t), f.time_s)) from fr f where f.stream_id = x.stream_id) as o from x join en on en.stream_id = x.stream_id where x.t between en.first_s and en.last_end_s)
    select stream_id, hyp_id, 'HARD_CUT' as split_kind, o as incoming_offset, o as outgoing_offset from y""",
    ),
    "q97_scan_times": B.with_sql(
        "fr",
        FIXED_SQL
        + """, x as (select stream_id, k as n, candidate_s - case when k % 2 = 0 then 9.7::double else 0 end as a from ca),
    g as (select stream_id, n, round(a - 2 + i * 0.1::double, 9) as time_s from x, (select unnest(generate_series(0, 40)) as i))
    select stream_id, time_s, max(n) as anchor_n from g where time_s >= 0 group by stream_id, time_s""",
    ),
    "q98_search_bounds": B.with_sql(
        "lv",
        """x as (select stream_id, idx, floor(rms) * 0.5::double as t from lv where rms < 20)
    select stream_id, cast(count(distinct t) as int) as n_times, min(t) as start_s, max(t) as end_s, arg_min(t, idx) as first_time from x group by stream_id""",
    ),
}
