"""Which evidence stands for which side of a transition: handoffs and edge fades, by the kind that owns it.

Contexts carry hyps, regions, one_sided, outs, ins, geometries, island, and the associations out and inc (evidence.py).
Roles are a struct of ids: outgoing_id, incoming_id (hypotheses), outgoing_fade, incoming_fade (start_idx of fades).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evidence import IS_SUPPORTED
from .islands import INSIDE, owners

STRUCTURAL = "({h}.n_structural > 0 and {h}.n_basin = 0)"


def role(outgoing: str = "null", incoming: str = "null", outgoing_fade: str = "null", incoming_fade: str = "null") -> str:
    return f"named_struct('outgoing_id', cast({outgoing} as long), 'incoming_id', cast({incoming} as long), 'outgoing_fade', cast({outgoing_fade} as long), 'incoming_fade', cast({incoming_fade} as long))"


def interstitial(contexts: DataFrame, name: str = "roles") -> DataFrame:
    """Roles of an interstitial, by the first of these that applies:

    the only region, if both edges are supported and the reference is between them and in neither basin; the last completed
    pair of fades and the first to come, if different basins own them alone; without regions, the only completed pair with
    exactly one structural witness, and the only owner to come; exactly two supported handoffs; the association that alone is
    supported, with the region's right edge if it is the left one.
    """
    x = contexts.withColumn("__sup", F.expr(f"filter(hyps, h -> {IS_SUPPORTED.format(h='h')})"))
    r = "get(regions, 0)"
    around = f"size(regions) = 1 and {r}.l.time_s < reference_s and reference_s < {r}.r.time_s and not {INSIDE.format(t='reference_s', h=r + '.l')} and not {INSIDE.format(t='reference_s', h=r + '.r')}"
    only = lambda t: f"if(size({owners(t)}) = 1, get({owners(t)}, 0).hyp_id, null)"
    done = f"array_max(filter(transform(geometries, (g, n) -> struct(g.incoming_established_s as e, g.floor_s as f, -n as n, g as g, {only('g.floor_s')} as owner)), p -> p.g.incoming_established_s < reference_s and p.owner is not null))"
    soon = f"array_min(filter(transform(geometries, (g, n) -> struct(g.incoming_start_s as s, g.floor_s as f, n as n, g as g, {only('g.incoming_start_s')} as owner)), p -> p.g.incoming_start_s >= reference_s and p.owner is not null))"
    x = x.withColumn("__done", F.expr(done)).withColumn("__soon", F.expr(soon))
    fade_of = "array_min(transform(filter(ins, i -> i.start_s = {g}.incoming_start_s), i -> i.start_idx))"
    witness = f"filter(geometries, g -> g.incoming_established_s < reference_s and size(filter(hyps, h -> {STRUCTURAL.format(h='h')} and h.time_s between greatest(g.incoming_start_s, g.floor_s) and g.incoming_established_s)) = 1)"
    right = f"array_distinct(filter(transform(filter(geometries, g -> g.incoming_start_s >= reference_s), g -> {only('g.incoming_start_s')}), o -> o is not null))"
    x = x.withColumn("__left", F.expr(witness)).withColumn("__right", F.expr(right))
    held = lambda side: f"if(exists(__sup, h -> h.hyp_id = {side}.h.hyp_id), {side}.h.hyp_id, null)"
    x = x.withColumn("__o", F.expr(held("out"))).withColumn("__i", F.expr(held("inc")))
    roles = f"""case
      when {around} then {role(f'{r}.l.hyp_id', f'{r}.r.hyp_id')}
      when __done is not null and __soon is not null and __done.n <> -__soon.n and __done.owner <> __soon.owner then {role('__done.owner', '__soon.owner', '__done.g.start_idx', fade_of.format(g='__soon.g'))}
      when size(regions) = 0 and size(__left) = 1 and size(__right) = 1 then {role(incoming='__right[0]', outgoing_fade='__left[0].start_idx')}
      when size(__sup) = 2 then {role('__sup[0].hyp_id', '__sup[1].hyp_id')}
      when __o is not null and __i is null and size(regions) = 1 and {r}.l.hyp_id = __o then {role('__o', f'{r}.r.hyp_id')}
      when __o is not null and __i is null then {role('__o')}
      when __i is not null and __o is null then {role(incoming='__i')} end"""
    return x.withColumn(name, F.expr(roles)).drop("__sup", "__done", "__soon", "__left", "__right", "__o", "__i")


def island(name: str = "island") -> str:
    """Roles of an island: its handoff, and the left edge of its region."""
    return f"if({name} is null, null, {role(f'{name}.region.l.hyp_id', f'{name}.handoff.hyp_id')})"


def floor(handoff: str = "handoff_id", fade: str = "floor_fade") -> str:
    """Roles of a fade to its floor: the handoff that owns it, if one does, and the fade."""
    return f"if({fade} is null, null, {role(incoming=handoff, outgoing_fade=fade)})"


def hard_cut() -> str:
    """Roles of a cut: the only supported handoff, if both associations name it."""
    sup = f"filter(hyps, h -> {IS_SUPPORTED.format(h='h')})"
    return f"if(size({sup}) = 1 and out.h.hyp_id = get({sup}, 0).hyp_id and inc.h.hyp_id = out.h.hyp_id, {role('out.h.hyp_id', 'inc.h.hyp_id')}, null)"


def insert(contexts: DataFrame, name: str = "roles") -> DataFrame:
    """Roles of a bounded insert.

    Symmetric: incoming is the right edge. Outgoing is the left edge, if the outgoing association is on it, unless nothing lies
    between it and the supported hypothesis before, which owns one steeper and deeper fall while the left edge owns the one
    associated; an earlier supported one, if the association is on it and all between is structural; else the one before the
    left edge, if something, and only structure, is between. Asymmetric: outgoing is the supported one before the primary, if
    all between is structural; incoming the right edge of the only symmetric region whose left edge is primary.
    """
    r, a = "get(regions, 0)", "get(one_sided, 0)"
    before = lambda t: f"array_max(filter(hyps, h -> {IS_SUPPORTED.format(h='h')} and h.time_s < {t}))"
    x = contexts.withColumn("__p", F.expr(before(f"{r}.l.time_s"))).withColumn("__q", F.expr(before(f"{a}.primary.time_s")))
    between = lambda p, t: f"filter(hyps, h -> h.time_s > {p}.time_s and h.time_s < {t})"
    plain = lambda hyps: f"forall({hyps}, h -> {STRUCTURAL.format(h='h')})"
    x = x.withColumn("__mid", F.expr(between("__p", f"{r}.l.time_s")))
    falls = lambda h: f"filter(outs, o -> {INSIDE.format(t='o.floor_s', h=h)})"
    x = x.withColumn("__lf", F.expr(falls(f"{r}.l"))).withColumn("__pf", F.expr(falls("__p")))
    replaced = "size(__mid) = 0 and size(__lf) = 1 and size(__pf) = 1 and __lf[0].start_idx = out.f.start_idx and __pf[0].descent_ratio > __lf[0].descent_ratio and __pf[0].floor_rms < __lf[0].floor_rms"
    earlier = f"out.h.time_s < {r}.l.time_s and {IS_SUPPORTED.format(h='out.h')} and {plain(between('out.h', f'{r}.l.time_s'))}"
    outgoing = f"""case when out.h.hyp_id = {r}.l.hyp_id then if(coalesce({replaced}, false), __p.hyp_id, {r}.l.hyp_id)
      when coalesce({earlier}, false) then out.h.hyp_id
      when __p is not null and size(__mid) > 0 and {plain('__mid')} then __p.hyp_id end"""
    own = f"filter(regions, g -> g.l.hyp_id = {a}.primary.hyp_id)"
    primary = f"if(__q is not null and {plain(between('__q', f'{a}.primary.time_s'))}, __q.hyp_id, null)"
    right = f"if(size({own}) = 1, get({own}, 0).r.hyp_id, null)"
    roles = f"case when symmetric_insert then {role(f'({outgoing})', f'{r}.r.hyp_id')} when asymmetric_insert then {role(primary, right)} end"
    return x.withColumn(name, F.expr(roles)).drop("__p", "__q", "__mid", "__lf", "__pf")


def provenance() -> str:
    """Which insert owns a context: SYMMETRIC before ASYMMETRIC."""
    return "case when symmetric_insert then 'SYMMETRIC' when asymmetric_insert then 'ASYMMETRIC' end"
