"""Acoustic islands: material between a decay and the next handoff that neither side owns.

Contexts carry `hyps`, `regions` (evidence.py), `outs` and `ins` (fades around the reference). All of a context is at hand in
its row, so an island is an expression over its arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evidence import IS_SUPPORTED

HORIZON = 8.0
#: Twelve decibels.
RESET = 10.0 ** 0.6
INSIDE = "{t} between {h}.start_s and {h}.recovery_s"


def owners(t: str) -> str:
    """The supported hypotheses whose basin holds a time."""
    return f"filter(hyps, h -> {IS_SUPPORTED.format(h='h')} and {INSIDE.format(t=t, h='h')})"


def grace(o: str) -> str:
    """How long after a floor a reset still belongs to the fall: a quarter of its length, half a second to two."""
    return f"least(2D, greatest(0.5D, 0.25D * greatest(0D, {o}.floor_s - {o}.start_s)))"


def strength(i: str) -> str:
    return f"least({i}.ascent_ratio, {i}.persistence_ratio)"


def with_island(contexts: DataFrame, horizon: float = HORIZON, reset: float = RESET) -> DataFrame:
    """contexts with canonical (the only region strictly around the reference, which is in neither basin) and island: handoff, decay, reset, region; null where there is none.

    A reset is a climb of `reset` or more that starts while a fall lasts, or shortly after, and that no basin owns. Without a
    canonical region, a reset that comes later, but within the horizon, may begin a long island.
    """
    x = contexts.withColumn("__c", F.expr(f"filter(regions, g -> g.l.time_s < reference_s and reference_s < g.r.time_s and not {INSIDE.format(t='reference_s', h='g.l')} and not {INSIDE.format(t='reference_s', h='g.r')})"))
    x = x.withColumn("canonical", F.expr("if(size(__c) = 1, __c[0], null)"))
    x = x.withColumn("__sup", F.expr(f"filter(hyps, h -> {IS_SUPPORTED.format(h='h')})"))
    x = x.withColumn("__resets", F.expr(f"transform(filter(ins, i -> {strength('i')} >= {reset}D), i -> struct(i.start_s as start_s, {strength('i')} as strength, size({owners('i.start_s')}) = 1 as owned, i as reset))"))
    x = x.withColumn("__near", F.expr(f"transform(filter(outs, o -> abs(o.floor_s - reference_s) <= {horizon}D), o -> struct(o as decay, filter(__resets, r -> r.start_s between o.start_s and o.floor_s + {grace('o')} and r.start_s < reference_s) as met))"))
    x = x.withColumn("__first", F.expr("transform(__near, n -> struct(n.decay as decay, n.met as met, array_min(filter(n.met, r -> not r.owned)) as r))"))
    x = x.withColumn("__own", F.expr("filter(__first, n -> n.r is not null and not exists(n.met, m -> m.owned and m.start_s > n.r.start_s and m.strength >= n.r.strength))"))
    later = "filter(__sup, h -> h.time_s > greatest(reference_s, n.decay.floor_s, n.r.reset.established_s))[0]"
    x = x.withColumn("__ends", F.expr(f"filter(transform(__own, n -> struct(n.r.strength as strength, -n.r.start_s as back, n.decay as decay, n.r.reset as reset, if(canonical is not null, canonical.r, get({later[:-3]}, 0)) as handoff)), e -> e.handoff is not null)"))
    x = x.withColumn("__pick", F.expr("array_max(transform(__ends, (e, n) -> struct(e.strength as strength, e.back as back, -n as n, n as at)))"))
    x = x.withColumn("__short", F.expr("if(__pick is null, null, __ends[__pick.at])"))
    chains = f"""flatten(transform(filter(outs, o -> o.descent_ratio >= {reset}D), o -> flatten(transform(
      filter(__resets, r -> r.start_s - o.floor_s > {grace('o')} and r.start_s - o.floor_s <= {horizon}D), r -> transform(
      filter(__sup, h -> h.time_s - r.start_s > {horizon}D and abs(h.time_s - reference_s) <= {horizon}D),
      h -> struct(abs(h.time_s - reference_s) as distance, r.start_s - o.floor_s as gap, h.time_s - r.start_s as length, o as decay, r.reset as reset, h as handoff))))))"""
    x = x.withColumn("__chains", F.expr(f"array_sort({chains})"))
    x = x.withColumn("__long", F.expr("if(canonical is null and size(__chains) > 0 and size(filter(__chains, c -> abs(c.distance - __chains[0].distance) < 1e-9)) = 1, __chains[0], null)"))
    found = "named_struct('handoff', {e}.handoff, 'decay', {e}.decay, 'reset', {e}.reset, 'region', canonical)"
    none = "named_struct('handoff', canonical.r, 'decay', cast(null as {o}), 'reset', cast(null as {i}), 'region', canonical)"
    kinds = {n: contexts.schema[a].dataType.elementType.simpleString() for n, a in (("o", "outs"), ("i", "ins"))}
    island = F.expr(f"case when __short is not null then {found.format(e='__short')} when __long is not null then {found.format(e='__long')} when canonical is not null then {none.format(**kinds)} end")
    return x.withColumn("island", island).drop("__c", "__sup", "__resets", "__near", "__first", "__own", "__ends", "__pick", "__short", "__chains", "__long")


def absorbed(peak: str = "array_max(transform(hyps, h -> h.novelty))") -> str:
    """Whether a fall's rise lies in the right basin of the only region, whose left edge alone is the strongest peak and that has one structural hypothesis inside."""
    r = "get(regions, 0)"
    single = f"size(filter({r}.interior, h -> h.n_structural > 0 and h.n_basin = 0)) = 1"
    rise = f"exists(outs, o -> o.rise_s is not null and {INSIDE.format(t='o.rise_s', h=r + '.r')})"
    return f"coalesce(size(regions) = 1 and not symmetric_insert and {r}.l.novelty = {peak} and not coalesce({r}.r.novelty = {peak}, false) and {single} and {rise}, false)"


def left_retracted(decision: str, island: str = "island") -> str:
    """An exclusion whose outgoing edge moves back to the decay's floor, or its reset, whichever is earlier; null where that isn't earlier."""
    edge = f"least({island}.decay.floor_s, {island}.reset.start_s)"
    fits = f"{decision}.kind = 'EXCLUSION' and {island}.decay is not null and {edge} < {decision}.outgoing_end_s and {edge} < {decision}.incoming_start_s"
    return f"if({fits}, named_struct('kind', 'EXCLUSION', 'incoming_start_s', {decision}.incoming_start_s, 'outgoing_end_s', {edge}), null)"
