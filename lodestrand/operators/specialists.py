"""Geometry that owners of a transition choose from its evidence: contexts with `hyps` (by time), `regions` and `one_sided` of evidence.py.

Each adds a struct (kind, incoming_start_s, outgoing_end_s), or null where it abstains; ladders are the first that doesn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import IS_SUPPORTED
from .islands import left_retracted

STRUCTURAL_ONLY = "({h}.n_structural > 0 and {h}.n_basin = 0)"
CUT = "named_struct('kind', 'HARD_CUT', 'incoming_start_s', {t}, 'outgoing_end_s', {t})"
EXCLUSION = "if({o} < {i}, named_struct('kind', 'EXCLUSION', 'incoming_start_s', {i}, 'outgoing_end_s', {o}), null)"


def supported_exclusion(contexts: DataFrame, selected: str, name: str = "exclusion") -> DataFrame:
    """Between the neighbours of the selected time, if both are supported: from the left one (or the selected time, if that is nearer to the right one) to the right one's recovery."""
    x = contexts.withColumn("__l", F.expr(f"get(filter(hyps, h -> h.time_s < {selected}), size(filter(hyps, h -> h.time_s < {selected})) - 1)"))
    x = x.withColumn("__r", F.expr(f"get(filter(hyps, h -> h.time_s > {selected}), 0)"))
    outgoing = f"if({selected} - __l.time_s <= __r.time_s - {selected}, least(__l.time_s, __l.recovery_s), {selected})"
    both = f"{IS_SUPPORTED.format(h='__l')} and {IS_SUPPORTED.format(h='__r')}"
    return x.withColumn(name, F.expr(f"if(coalesce({both}, false), {EXCLUSION.format(o=outgoing, i='greatest(__r.time_s, __r.recovery_s)')}, null)")).drop("__l", "__r")


def structural_bridge(region: str = "get(regions, 0)") -> Column:
    """A region whose only interior is structural and nearer to the reference than its edges: a cut there."""
    b = f"get({region}.interior, 0)"
    near = lambda h: f"abs({h}.time_s - reference_s)"
    closest = f"{near(b)} < {near(f'{region}.l')} and {near(b)} <= {near(f'{region}.r')}"
    return F.expr(f"if(size({region}.interior) = 1 and {STRUCTURAL_ONLY.format(h=b)} and {closest}, {CUT.format(t=f'{b}.time_s')}, null)")


def symmetric_outer(region: str = "get(regions, 0)") -> Column:
    """From the last supported hypothesis before the region, if something and only structure lies between, to its right edge."""
    before = f"filter(hyps, h -> h.time_s < {region}.l.time_s and {IS_SUPPORTED.format(h='h')})"
    last = f"get({before}, size({before}) - 1)"
    between = f"filter(hyps, h -> h.time_s > {last}.time_s and h.time_s < {region}.l.time_s)"
    return F.expr(f"if(size({before}) > 0 and size({between}) > 0 and forall({between}, h -> {STRUCTURAL_ONLY.format(h='h')}), {EXCLUSION.format(o=f'{last}.time_s', i=f'{region}.r.time_s')}, null)")


def symmetric_phase(region: str = "get(regions, 0)") -> Column:
    """From the left edge or its recovery, whichever is earlier, to the right edge."""
    return F.expr(EXCLUSION.format(o=f"least({region}.l.time_s, {region}.l.recovery_s)", i=f"{region}.r.time_s"))


def asymmetric_fallback(region: str = "get(one_sided, 0)") -> Column:
    """From the primary's recovery to the complementary's, or its time without a basin."""
    return F.expr(EXCLUSION.format(o=f"{region}.primary.recovery_s", i=f"coalesce({region}.complementary.recovery_s, {region}.complementary.time_s)"))


def insert_geometry(contexts: DataFrame, rise: Column, name: str = "insert") -> DataFrame:
    """The ladder of a bounded insert: with exactly one symmetric region bridge, outer extent (without a rise), phases; else with exactly one asymmetric region its outer extent or fallback. Fades and islands, where contexts have them, may move the outgoing edge back."""
    symmetric = F.coalesce(structural_bridge(), F.when(~rise, symmetric_outer()), symmetric_phase())
    asymmetric = F.coalesce(F.when(~rise, F.expr(asymmetric_outer())), asymmetric_fallback())
    x = contexts.withColumn(name, F.when(F.size("regions") == 1, symmetric).when(F.size("one_sided") == 1, asymmetric))
    if "outs" in contexts.columns:  # with fades at hand, the outgoing edge may go back
        x = x.withColumn(name, F.coalesce(F.when(F.size("regions") == 1, F.expr(predecessor_fade(name))), F.col(name)))
    if "island" in contexts.columns:
        x = x.withColumn(name, F.coalesce(F.expr(left_retracted(name)), F.col(name)))
    return x


def terminal_handoff(boundary: str = "boundary_s", selected: str = "selected_s") -> str:
    """A cut at a basin's recovery moves back to the floor of the only fall that ends in it after its minimum, where exactly one climb starts; null where it abstains."""
    basins = f"filter(hyps, h -> h.recovery_s = {boundary} and {selected} between h.minimum_s and h.recovery_s)"
    b = f"get({basins}, 0)"
    falls = f"filter(outs, o -> o.start_s < o.floor_s and o.floor_s >= {b}.minimum_s and o.floor_s < {b}.recovery_s)"
    t = f"get({falls}, 0).floor_s"
    one = f"size({basins}) = 1 and {b}.n_basin > 0 and {b}.n_structural > 0 and reference_s >= {b}.recovery_s and size({falls}) = 1 and size(filter(ins, i -> i.start_s = {t} and i.established_s > {t})) = 1"
    return f"if(coalesce({one}, false), {t}, null)"


def dominant_basin(decision: str = "decision") -> str:
    """An exclusion whose incoming edge is the recovery of the only basin with the strongest peak begins with that basin, or at its minimum if the peak is the recovery; null where it abstains."""
    peak = "array_max(transform(hyps, h -> h.novelty))"
    hits = f"filter(hyps, h -> h.recovery_s = {decision}.incoming_start_s and h.novelty = {peak})"
    h = f"get({hits}, 0)"
    fits = f"{decision}.kind = 'EXCLUSION' and size({hits}) = 1 and {h}.n_basin = 1 and reference_s >= {h}.minimum_s and {decision}.outgoing_end_s < {h}.start_s and {h}.start_s < {decision}.incoming_start_s"
    return f"if(coalesce({fits}, false), {EXCLUSION.format(o=f'if({h}.peak_s = {h}.recovery_s, {h}.minimum_s, {h}.start_s)', i=f'{decision}.incoming_start_s')}, null)"


def terminal_fade(decision: str = "decision", rise: str = "rise") -> str:
    """An exclusion goes on to the floor of the only fall across its outgoing edge that ends in the right basin of the only region, which holds the reference and is weaker than its left; null where it abstains."""
    r, peak = "get(regions, 0)", "array_max(transform(hyps, h -> h.novelty))"
    inside = "reference_s between {h}.start_s and {h}.recovery_s"
    falls = f"filter(outs, o -> o.start_s <= {decision}.outgoing_end_s and {decision}.outgoing_end_s < o.floor_s and o.floor_s < {decision}.incoming_start_s and o.floor_s between {r}.r.start_s and {r}.r.recovery_s)"
    fits = f"""{decision}.kind = 'EXCLUSION' and not {rise} and size(regions) = 1 and {inside.format(h=r + '.r')} and not {inside.format(h=r + '.l')} and not exists({r}.interior, h -> {STRUCTURAL_ONLY.format(h='h')})
      and {r}.l.novelty = {peak} and not coalesce({r}.r.novelty = {peak}, false) and size({falls}) = 1"""
    return f"if(coalesce({fits}, false), {EXCLUSION.format(o=f'get({falls}, 0).floor_s', i=f'{decision}.incoming_start_s')}, null)"


def structure_precedes_basin(h: str) -> str:
    """Whether a hypothesis and all its structural proposals lie before its basin."""
    return f"coalesce({h}.time_s < {h}.start_s and {h}.last_peak_s < {h}.start_s, false)"


def by_order(incoming: str, outgoing: str) -> str:
    """A cut where the edges meet, a crossfade where incoming comes first, else an exclusion."""
    return f"named_struct('kind', case when {incoming} = {outgoing} then 'HARD_CUT' when {incoming} < {outgoing} then 'CROSSFADE' else 'EXCLUSION' end, 'incoming_start_s', {incoming}, 'outgoing_end_s', {outgoing})"


def fade_geometry(selected: str = "selected_s", rise: str = "rise_at") -> str:
    """The ladder of a fade: its floor up to the handoff (or the reference); the only pair that both associations name; without a rise, or with one too far out, a cut; nothing past the rise; else a crossfade of both associations, or up to the rise."""
    pairs = "filter(geometries, g -> g.start_idx = out.f.start_idx and g.incoming_start_s = inc.f.start_s)"
    g = f"get({pairs}, 0)"
    handoff = "get(filter(hyps, h -> h.hyp_id = handoff_id), 0).time_s"
    end = f"if(handoff_id is null, reference_s, {handoff})"
    return f"""case
      when floor_s is not null and floor_s < {end} then named_struct('kind', 'EXCLUSION', 'incoming_start_s', {end}, 'outgoing_end_s', floor_s)
      when size({pairs}) = 1 then {by_order(f'{g}.incoming_start_s', f'{g}.floor_s')}
      when {rise} is null then {CUT.format(t=selected)}
      when {selected} >= {rise} then null
      when reference_s - {selected} >= 0 and {rise} - reference_s > reference_s - {selected} then {CUT.format(t=selected)}
      when inc.h.time_s < out.h.time_s then named_struct('kind', 'CROSSFADE', 'incoming_start_s', inc.h.time_s, 'outgoing_end_s', out.h.time_s)
      else named_struct('kind', 'CROSSFADE', 'incoming_start_s', {selected}, 'outgoing_end_s', {rise}) end"""


def predecessor_fade(decision: str = "decision") -> str:
    """A symmetric insert's outgoing edge goes back to the floor of the only fall that ends between the supported hypothesis before the region and that edge; null where it abstains."""
    r = "get(regions, 0)"
    p = f"array_max(filter(hyps, h -> {IS_SUPPORTED.format(h='h')} and h.time_s < {r}.l.time_s))"
    falls = f"filter(outs, o -> o.floor_s > {p}.time_s and o.floor_s < {decision}.outgoing_end_s and o.rise_s is null)"
    fits = f"{decision}.kind = 'EXCLUSION' and size(regions) = 1 and size({falls}) = 1"
    return f"if(coalesce({fits}, false), {EXCLUSION.format(o=f'get({falls}, 0).floor_s', i=f'{decision}.incoming_start_s')}, null)"


def asymmetric_outer() -> str:
    """From the supported hypothesis before the primary, if only structure is between, to the right edge of the only symmetric region whose left edge is the primary; null where it abstains."""
    a = "get(one_sided, 0)"
    own = f"filter(regions, g -> g.l.hyp_id = {a}.primary.hyp_id)"
    p = f"array_max(filter(hyps, h -> {IS_SUPPORTED.format(h='h')} and h.time_s < {a}.primary.time_s))"
    plain = f"forall(filter(hyps, h -> h.time_s > {p}.time_s and h.time_s < {a}.primary.time_s), h -> {STRUCTURAL_ONLY.format(h='h')})"
    return f"if(coalesce(size({own}) = 1 and {p} is not null and {plain}, false), {EXCLUSION.format(o=f'{p}.time_s', i=f'get({own}, 0).r.time_s')}, null)"


def interstitial_geometry(contexts: DataFrame, selected: str = "selected_s", name: str = "interstitial") -> DataFrame:
    """The ladder of an interstitial, over roles (roles.py) and the island; its exclusions go through the basin and fade refinements.

    An island without a region, by its decay and reset; one with a region whose left edge goes back; both edge fades by
    their order; an outgoing fade with a supported handoff; both associations on one handoff, by the order of the pair; else a
    cut at the selected time, refined by what comes in.
    """
    by_id = lambda i: f"get(filter(hyps, h -> h.hyp_id = {i}), 0)"
    floor = "get(filter(outs, o -> o.start_idx = roles.outgoing_fade), 0).floor_s"
    start = "get(filter(ins, i -> i.start_idx = roles.incoming_fade), 0).start_s"
    x = contexts.withColumn("__h", F.expr(by_id("roles.incoming_id"))).withColumn("__g", F.expr(by_id("roles.outgoing_id")))
    alone = EXCLUSION.format(o="least(island.decay.floor_s, island.reset.start_s)", i="island.handoff.time_s")
    whole = EXCLUSION.format(o="__g.time_s", i="__h.time_s")
    x = x.withColumn("__w", F.expr(f"if(island.region is not null and island.decay is not null and __g.hyp_id = island.region.l.hyp_id, {whole}, null)"))
    x = incoming_or_cut(x, selected)
    ladder = f"""case
      when island is not null and island.region is null and {alone} is not null then {alone}
      when __w is not null and {left_retracted('__w')} is not null then {left_retracted('__w')}
      when roles.outgoing_fade is not null and roles.incoming_fade is not null then {by_order(start, floor)}
      when roles.outgoing_fade is not null and __h is not null and {EXCLUSION.format(o=floor, i='greatest(__h.time_s, __h.recovery_s)')} is not null then {EXCLUSION.format(o=floor, i='greatest(__h.time_s, __h.recovery_s)')}
      when __g.hyp_id = __h.hyp_id and out.h.hyp_id = __h.hyp_id and inc.h.hyp_id = __h.hyp_id then {by_order('inc.f.start_s', 'out.f.floor_s')}
      else __cut end"""
    x = x.withColumn("__d", F.expr(ladder))
    pair = f"if(__g.hyp_id <> __h.hyp_id, {EXCLUSION.format(o='least(__g.time_s, __g.recovery_s)', i='greatest(__h.time_s, __h.recovery_s)')}, null)"
    exclusion = F.coalesce(F.expr(pair), F.expr(dominant_basin("__d")), F.expr(terminal_fade("__d")), F.col("__d"))
    x = supported_exclusion(x, selected, "__x")
    other = F.coalesce("__x", later_reference_basin(F.col("__d.kind"), F.col("__d.outgoing_end_s"), F.col("__d")))
    return x.withColumn(name, F.when(F.col("__d.kind") == "EXCLUSION", exclusion).otherwise(other)).drop("__h", "__g", "__w", "__cut", "__d", "__x")


def conservative(decision: str) -> str:
    """An interstitial's exclusion becomes a cut at the reference where only an island's region speaks for it: no fall to silence ends near its outgoing edge, no insert owns the context, the island has the roles' region and neither decay nor reset, and the reference is inside."""
    silent = f"exists(outs, o -> o.floor_rms = 0 and o.floor_s < reference_s and abs(o.floor_s - {decision}.outgoing_end_s) <= 1.5D)"
    own = "island.region is not null and island.region.l.hyp_id = roles.outgoing_id and island.region.r.hyp_id = roles.incoming_id and island.decay is null and island.reset is null"
    guard = f"{decision}.kind = 'EXCLUSION' and not {silent} and not symmetric_insert and not asymmetric_insert and {own} and {decision}.outgoing_end_s < reference_s and reference_s < {decision}.incoming_start_s"
    return f"if(coalesce({guard}, false), {CUT.format(t='reference_s')}, {decision})"


def incoming_or_cut(contexts: DataFrame, selected: str) -> DataFrame:
    """contexts with __cut: a cut at the selected time, or an exclusion up to the earliest of two or more recoveries after it."""
    later = f"transform(filter(hyps, h -> {IS_SUPPORTED.format(h='h')} and h.recovery_s > {selected}), h -> h.recovery_s)"
    return contexts.withColumn("__cut", F.expr(f"if(size({later}) >= 2, {EXCLUSION.format(o=selected, i=f'array_min({later})')}, {CUT.format(t=selected)})"))


def dispatched(c: DataFrame, name: str = "decision") -> DataFrame:
    """The struct of the specialist that the kind names: columns insert, interstitial, fade, cut; AMBIGUOUS cuts at the reference. A verified silence gap (`silence`, if there is such a column) goes before all."""
    reference = F.expr(CUT.format(t="reference_s"))
    chosen = F.when(F.col("kind") == "BOUNDED_INSERT", F.col("insert")).when(F.col("kind") == "INTERSTITIAL", F.col("interstitial")).when(F.col("kind") == "FADE", F.col("fade")).when(F.col("kind") == "HARD_CUT", F.col("cut")).otherwise(reference)
    return c.withColumn(name, F.coalesce("silence", chosen) if "silence" in c.columns else chosen)


def false_exclusion(decision: str, handoff: str, loud: str, longest: float = 4.0, margin: float = 1.0) -> str:
    """An exclusion of `longest` seconds or more with a spectral handoff well inside, loud on both sides, is a cut there."""
    fits = f"{decision}.kind = 'EXCLUSION' and {decision}.incoming_start_s - {decision}.outgoing_end_s >= {longest}D and {handoff} - {decision}.outgoing_end_s >= {margin}D and {decision}.incoming_start_s - {handoff} >= {margin}D and {loud}"
    return f"if(coalesce({fits}, false), {CUT.format(t=handoff)}, {decision})"


def verified(decision: str, incoming: str, outgoing: str, ceiling: str = "null") -> str:
    """A decision whose edges move to verified times (null: as they are), the outgoing one not past the ceiling; the old decision where that turns their order."""
    i, o = f"coalesce({incoming}, {decision}.incoming_start_s)", f"least(coalesce({outgoing}, {decision}.outgoing_end_s), coalesce({ceiling}, 1e300D))"
    cut = f"coalesce({outgoing}, {incoming}, {decision}.outgoing_end_s)"
    keeps = f"({decision}.kind = 'CROSSFADE' and {i} < {o}) or ({decision}.kind = 'EXCLUSION' and {o} < {i})"
    return f"case when {decision}.kind = 'HARD_CUT' then {CUT.format(t=cut)} when {keeps} then named_struct('kind', {decision}.kind, 'incoming_start_s', {i}, 'outgoing_end_s', {o}) else {decision} end"


def later_reference_basin(kind: Column, outgoing: Column, decision: Column, region: str = "get(regions, 0)") -> Column:
    """A failed cut moves to the minimum of the only region's right basin, if the reference lies in it, it is supported and later."""
    inside = F.expr(f"size(regions) = 1 and reference_s between {region}.r.start_s and {region}.r.recovery_s and {IS_SUPPORTED.format(h=f'{region}.r')}")
    later = F.expr(CUT.format(t=f"{region}.r.minimum_s"))
    return F.when((kind == "HARD_CUT") & F.coalesce(inside, F.lit(False)) & (F.expr(f"{region}.r.minimum_s") > outgoing), later).otherwise(decision)


def outgoing_discovery(contexts: DataFrame, selected: str, incoming: str, name: str = "outgoing_s") -> DataFrame:
    """Of HIGH hypotheses before the incoming edge the nearest to the selected time, the earlier of two."""
    high = f"filter(hyps, h -> h.confidence = 'HIGH' and h.time_s < {incoming})"
    return contexts.withColumn(name, F.expr(f"get(array_sort(transform({high}, h -> struct(abs(h.time_s - {selected}) as d, h.time_s as t))), 0).t"))


def unpacked(df: DataFrame, name: str) -> DataFrame:
    """The struct's fields as columns; rows that abstain go."""
    return df.where(F.col(name).isNotNull()).select(*[c for c in df.columns if c not in (name, "hyps", "regions", "one_sided")], f"{name}.*")
