"""SQL of basins and fades as DuckDB sees them: state by state along each stream, where the operators use running extremes."""

from __future__ import annotations

RISES = """rx as (select *, avg(rms) over (partition by stream_id order by idx rows between 3 preceding and 1 preceding) as b3, avg(rms) over (partition by stream_id order by idx rows between current row and 2 following) as a3,
    avg(rms) over (partition by stream_id order by idx rows between current row and 9 following) as l3, median(rms) over (partition by stream_id) as m3, count(*) over (partition by stream_id) as n3 from lv),
  ri as (select stream_id, start_s as rise_s from rx where idx >= 3 and idx < n3 - 10 and a3 / greatest(b3, 1e-9) >= 2.5 and l3 / greatest(b3, 1e-9) >= 3 and a3 / greatest(m3, 1e-9) >= 2.5)"""

SMOOTH = """sm as (select stream_id, idx, rms, median(rms) over (partition by stream_id order by idx rows between 1 preceding and 1 following) as s, count(*) over (partition by stream_id) as n from lv)"""

#: A state machine: st, sv the open segment's start and its height; fl, fv its extreme so far; e its last level; c.. the one that closes here.
WALK = """{w} as (select stream_id, 0::bigint as i, null::bigint as st, null::double as sv, null::bigint as fl, null::double as fv, null::bigint as cs, null::bigint as cf, null::bigint as ce from sm where idx = 0
  union all select w.stream_id, w.i + 1,
    case when st is null then case when m.s {opens} p.s then w.i end when m.s {closes} sv then null else st end,
    case when st is null then case when m.s {opens} p.s then p.s end when m.s {closes} sv then null else sv end,
    case when st is null then case when m.s {opens} p.s then w.i + 1 end when m.s {closes} sv then null when m.s {opens} fv then w.i + 1 else fl end,
    case when st is null then case when m.s {opens} p.s then m.s end when m.s {closes} sv then null when m.s {opens} fv then m.s else fv end,
    case when st is not null and m.s {closes} sv then st end, case when st is not null and m.s {closes} sv then fl end, case when st is not null and m.s {closes} sv then w.i end
  from {w} w join sm m on m.stream_id = w.stream_id and m.idx = w.i + 1 join sm p on p.stream_id = w.stream_id and p.idx = w.i),
{w}s as (select stream_id, cs as st, cf as fl, ce as en from {w} where cs is not null union all select {w}.stream_id, st, fl, n - 1 from {w} join sm on sm.stream_id = {w}.stream_id and sm.idx = {w}.i where st is not null and {w}.i = n - 1)"""

OUTGOING = (
    RISES + ", " + SMOOTH + ", " + WALK.format(w="ow", opens="<", closes=">=")
    + """, oa as (select g.*, (select arg_max(idx, row(rms, idx)) from lv where lv.stream_id = g.stream_id and idx between greatest(st, fl - 16) - 1 and greatest(st, fl - 16) + 1) as a from ows g where fl - st >= 3),
  ob as (select oa.*, (select arg_min(idx, row(rms, idx)) from lv where lv.stream_id = oa.stream_id and idx between greatest(a + 1, fl - 1) and fl + 1) as b from oa),
  oc as (select ob.*, x.rms as ar, y.rms as br, (select list(rms order by idx) from lv where lv.stream_id = ob.stream_id and idx between a and b) as part from ob join lv x on x.stream_id = ob.stream_id and x.idx = a join lv y on y.stream_id = ob.stream_id and y.idx = b where x.rms > y.rms),
  od as (select *, list_transform(range(1, len(part) + 1), lambda i: list_aggregate(part[greatest(1, i - 1):least(len(part), i + 1)], 'median')) as even from oc),
  ofd as (select stream_id, a as start_idx, b as floor_idx, a * 0.5::double as start_s, b * 0.5::double as floor_s, ar as start_rms, br as floor_rms, ar / greatest(br, 1e-9::double) as descent_ratio,
    len(list_filter(range(2, len(even) + 1), lambda i: even[i] <= even[i - 1]))::double / (len(even) - 1) as descent_consistency from od),
  og as (select ofd.*, (select min(rise_s) from ri where ri.stream_id = ofd.stream_id and rise_s > floor_s and rise_s <= floor_s + 8) as rise_s from ofd)"""
)

INCOMING = (
    WALK.format(w="iw", opens=">", closes="<=")
    + """, ia as (select g.*, (select arg_min(idx, row(rms, -idx)) from lv where lv.stream_id = g.stream_id and idx between st - 1 and st + 1) as a from iws g where en - st >= 3),
  ib as (select ia.*, (select arg_max(idx, row(rms, -idx)) from lv where lv.stream_id = ia.stream_id and idx between a + 1 and least(fl + 1, a + 16)) as b from ia),
  ic as (select ib.*, x.rms as ar, y.rms as br, (select list(rms order by idx) from lv where lv.stream_id = ib.stream_id and idx between a and least(en, a + 16)) as part,
    (select avg(rms) from lv where lv.stream_id = ib.stream_id and idx between b and b + 9) as held from ib join lv x on x.stream_id = ib.stream_id and x.idx = a join lv y on y.stream_id = ib.stream_id and y.idx = b where y.rms > x.rms),
  ig as (select stream_id, a as start_idx, b as established_idx, a * 0.5::double as start_s, b * 0.5::double as established_s, ar as start_rms, br as established_rms, br / greatest(ar, 1e-9::double) as ascent_ratio,
    len(list_filter(range(2, len(part) + 1), lambda i: part[i] >= part[i - 1]))::double / (len(part) - 1) as ascent_consistency, held / greatest(ar, 1e-9::double) as persistence_ratio from ic)"""
)

PAIRS = """fp as (select stream_id, start_idx, floor_s, anchor_s, p.s as incoming_start_s, p.e as incoming_established_s from (
    select o.stream_id, o.start_idx, o.floor_s, coalesce(o.rise_s, o.floor_s) as anchor_s,
      (select arg_min({'s': i.start_s, 'e': i.established_s}, row(abs(i.established_s - coalesce(o.rise_s, o.floor_s)), -i.ascent_consistency, -i.ascent_ratio, i.start_s)) from ig i where i.stream_id = o.stream_id and i.start_s <= coalesce(o.rise_s, o.floor_s)) as p from og o) where p is not null)"""

BASINS = """bs as (select *, median(rms) over (partition by stream_id order by idx rows between 6 preceding and 1 preceding) as base, median(rms) over (partition by stream_id order by idx rows between 2 preceding and current row) as last3,
    median(rms) over (partition by stream_id order by idx rows between 1 preceding and current row) as last2, median(rms) over (partition by stream_id order by idx rows between current row and 2 following) as ahead, count(*) over (partition by stream_id) as n from lv),
  bc as (select stream_id, idx, n, base from bs where idx >= 6 and idx < n - 3 and base > 0 and rms <= 0.5::double * base),
  bp as (select bc.*, coalesce((select min(p.idx) from bs p where p.stream_id = bc.stream_id and p.idx > bc.idx and case when p.idx = bc.idx + 1 then p.last2 else p.last3 end > 0.7::double * bc.base), bc.n) as p from bc),
  bm as (select bp.*, (select arg_min(idx, row(rms, idx)) from lv where lv.stream_id = bp.stream_id and lv.idx >= bp.idx and lv.idx < p) as m from bp),
  bl as (select bm.*, lv.rms as low from bm join lv on lv.stream_id = bm.stream_id and lv.idx = m),
  br as (select bl.*, (select min(r.idx) from bs r where r.stream_id = bl.stream_id and r.idx >= greatest(p, m + 1) and r.idx <= least(bl.n, p + 20) - 3 and r.ahead >= 0.5::double * bl.base and r.ahead >= 2.0::double * greatest(bl.low, 1e-12)) as r from bl),
  bk as (select * from br where r is not null),
  bg as (select stream_id, min(idx) as i from bk group by stream_id
    union all select g.stream_id, (select min(x.idx) from bk x where x.stream_id = g.stream_id and x.idx >= k.r + 3) from bg g join bk k on k.stream_id = g.stream_id and k.idx = g.i where exists (select 1 from bk x where x.stream_id = g.stream_id and x.idx >= k.r + 3))"""
