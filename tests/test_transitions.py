"""Golden cases of islands, roles and the specialists' steps, over contexts that are written out."""

import pytest
from lodestrand.operators import edges as E
from lodestrand.operators import islands as I
from lodestrand.operators import roles as R
from lodestrand.operators import specialists as P
from pyspark.sql import functions as F

HYP = "struct<time_s: double, hyp_id: long, n_basin: int, n_structural: int, start_s: double, minimum_s: double, recovery_s: double, novelty: double, peak_s: double, last_peak_s: double>"
OUT = "struct<start_idx: long, start_s: double, floor_s: double, start_rms: double, floor_rms: double, rise_s: double, descent_ratio: double, descent_consistency: double>"
IN = "struct<start_idx: long, start_s: double, established_s: double, ascent_ratio: double, ascent_consistency: double, persistence_ratio: double>"
PAIR = "struct<start_idx: long, floor_s: double, incoming_start_s: double, incoming_established_s: double>"
SCHEMA = f"""reference_s double, hyps array<{HYP}>, regions array<struct<l: {HYP}, r: {HYP}, interior: array<{HYP}>>>, one_sided array<struct<primary: {HYP}, complementary: {HYP}, interior: array<{HYP}>>>,
  outs array<{OUT}>, ins array<{IN}>, geometries array<{PAIR}>, out struct<f: {OUT}, h: {HYP}, distance_s: double>, inc struct<f: {IN}, h: {HYP}, distance_s: double>, selected_s double, boundary_s double, floor_s double, handoff_id long, rise_at double"""


def hyp(i, t, basin=1, structural=1, width=1.0, novelty=0.5, peak=None):
    t = float(t)
    edges = (t - width, t, t + width) if basin else (None, None, None)
    at = (t if peak is None else peak) if structural else None
    return (float(t), i, basin, structural, *edges, novelty if structural else None, at, at)


def fall(i, start, floor, ratio=10.0, low=0.1, rise=None):
    return (i, float(start), float(floor), low * ratio, low, rise, ratio, 1.0)


def climb(i, start, established, strength=10.0):
    return (i, float(start), float(established), strength, 1.0, strength)


@pytest.fixture
def context(spark):
    def make(reference, hyps=(), regions=(), outs=(), ins=(), geometries=(), one_sided=(), out=None, inc=None, selected=None, boundary=None, floor=None, handoff=None, rise=None):
        row = (float(reference), list(hyps), list(regions), list(one_sided), list(outs), list(ins), list(geometries), out, inc, selected, boundary, floor, handoff, rise)
        return spark.createDataFrame([row], SCHEMA)

    return make


def test_island_of_a_reset(context):
    handoff = hyp(1, 16)
    r = I.with_island(context(12, [handoff], outs=[fall(7, 8, 10)], ins=[climb(9, 10.2, 11)])).first().island
    assert (r.handoff.hyp_id, r.decay.start_idx, r.reset.start_idx, r.region) == (1, 7, 9, None)
    weak = I.with_island(context(12, [handoff], outs=[fall(7, 8, 10)], ins=[climb(9, 10.2, 11, 3.0)])).first()
    assert weak.island is None
    owned = I.with_island(context(12, [hyp(2, 10.2), handoff], outs=[fall(7, 8, 10)], ins=[climb(9, 10.2, 11)])).first()
    assert owned.island is None  # a basin owns the reset


def test_island_of_a_region_and_a_long_one(context):
    left, right = hyp(1, 5), hyp(2, 20)
    r = I.with_island(context(12, [left, right], [(left, right, [])])).first().island
    assert (r.handoff.hyp_id, r.decay, r.region.l.hyp_id) == (2, None, 1)
    inside = I.with_island(context(19.5, [left, right], [(left, right, [])])).first()
    assert inside.island is None
    far = I.with_island(context(22, [hyp(3, 24)], outs=[fall(7, 8, 10)], ins=[climb(9, 13, 14)])).first().island
    assert (far.handoff.hyp_id, far.reset.start_idx) == (3, 9)
    tied = I.with_island(context(22, [hyp(3, 24), hyp(4, 24)], outs=[fall(7, 8, 10)], ins=[climb(9, 13, 14)])).first()
    assert tied.island is None


def roles_of(df):
    r = R.interstitial(df).first().roles
    return r and (r.outgoing_id, r.incoming_id, r.outgoing_fade, r.incoming_fade)


def test_interstitial_roles(context):
    left, right = hyp(1, 5), hyp(2, 20)
    assert roles_of(context(12, [left, right], [(left, right, [])])) == (1, 2, None, None)
    pairs = [(7, 5.0, 5.5, 8.0), (8, 19.5, 20.0, 22.0)]
    assert roles_of(context(12, [left, right], geometries=pairs, ins=[climb(4, 5.5, 8), climb(5, 20, 22)])) == (1, 2, 7, 5)
    assert roles_of(context(12, [hyp(3, 7, basin=0), right], geometries=[(7, 6.0, 6.5, 8.0), (8, 19.5, 20.0, 22.0)])) == (None, 2, 7, None)
    assert roles_of(context(12, [left, right])) == (1, 2, None, None)
    assert roles_of(context(12, [left], out=(fall(7, 4, 5), left, 0.0))) == (1, None, None, None)
    assert roles_of(context(12, [left], inc=(climb(7, 12, 14), left, 0.0))) == (None, 1, None, None)
    assert roles_of(context(12, [hyp(3, 7, basin=0)])) is None


def test_cut_island_and_insert_roles(context):
    one = hyp(1, 10)
    both = context(10, [one], out=(fall(7, 8, 10), one, 0.0), inc=(climb(9, 10, 12), one, 0.0))
    assert both.select(F.expr(R.hard_cut()).alias("r")).first().r.outgoing_id == 1
    assert context(10, [one, hyp(2, 20)], out=(fall(7, 8, 10), one, 0.0), inc=(climb(9, 10, 12), one, 0.0)).select(F.expr(R.hard_cut()).alias("r")).first().r is None
    before, left, right, middle = hyp(0, 2), hyp(1, 10), hyp(2, 20), hyp(3, 6, basin=0)
    flags = lambda df, s=True: df.withColumn("symmetric_insert", F.lit(s)).withColumn("asymmetric_insert", F.lit(not s))
    r = R.insert(flags(context(12, [before, middle, left, right], [(left, right, [])]))).first().roles
    assert (r.outgoing_id, r.incoming_id) == (0, 2)
    r = R.insert(flags(context(12, [before, left, right], [(left, right, [])], out=(fall(7, 9, 10), left, 0.0)))).first().roles
    assert (r.outgoing_id, r.incoming_id) == (1, 2)
    steep = [fall(6, 1, 2, 50.0, 0.01), fall(7, 9, 10)]
    r = R.insert(flags(context(12, [before, left, right], [(left, right, [])], outs=steep, out=(fall(7, 9, 10), left, 0.0)))).first().roles
    assert r.outgoing_id == 0
    assert flags(context(1)).select(F.expr(R.provenance()).alias("p")).first().p == "SYMMETRIC"


def one(df, text):
    r = df.select(F.expr(text).alias("r")).first().r
    return tuple(r) if isinstance(r, tuple) else r


def test_terminal_handoff(context):
    basin = hyp(1, 10, width=2.0)
    df = context(13, [basin], outs=[fall(7, 8, 11)], ins=[climb(9, 11, 12)], selected=10.5, boundary=12.0)
    assert one(df, P.terminal_handoff()) == 11.0
    assert one(context(11, [basin], outs=[fall(7, 8, 11)], ins=[climb(9, 11, 12)], selected=10.5, boundary=12.0), P.terminal_handoff()) is None
    assert one(context(13, [basin], outs=[fall(7, 8, 11), fall(8, 9, 11.5)], ins=[climb(9, 11, 12)], selected=10.5, boundary=12.0), P.terminal_handoff()) is None


DECISION = "named_struct('kind', 'EXCLUSION', 'incoming_start_s', {i}D, 'outgoing_end_s', {o}D)"


def test_dominant_basin_and_terminal_fade(context):
    loud, quiet = hyp(1, 10, width=2.0, novelty=0.9), hyp(2, 4)
    d = DECISION.format(i=12.0, o=5.0)
    assert one(context(11, [quiet, loud]), P.dominant_basin(d)) == ("EXCLUSION", 12.0, 8.0)
    assert one(context(11, [quiet, hyp(1, 10, width=2.0, novelty=0.9, peak=12.0)]), P.dominant_basin(d)) == ("EXCLUSION", 12.0, 10.0)
    assert one(context(9, [quiet, loud]), P.dominant_basin(d)) is None
    left, right = hyp(1, 4, novelty=0.9), hyp(2, 10, width=2.0)
    df = context(10, [left, right], [(left, right, [])], outs=[fall(7, 4, 9)])
    assert one(df, P.terminal_fade(d, "false")) == ("EXCLUSION", 12.0, 9.0) and one(df, P.terminal_fade(d, "true")) is None


def test_fade_ladder(context):
    handoff = hyp(1, 12)
    assert one(context(10, [handoff], floor=8.0, handoff=1, selected=9.0), P.fade_geometry()) == ("EXCLUSION", 12.0, 8.0)
    assert one(context(10, floor=8.0, selected=9.0), P.fade_geometry()) == ("EXCLUSION", 10.0, 8.0)
    pair = {"out": (fall(7, 5, 9), handoff, 0.0), "inc": (climb(8, 7, 11), handoff, 0.0)}
    assert one(context(10, [handoff], geometries=[(7, 9.0, 7.0, 11.0)], selected=9.0, **pair), P.fade_geometry()) == ("CROSSFADE", 7.0, 9.0)
    assert one(context(10, selected=9.0), P.fade_geometry()) == ("HARD_CUT", 9.0, 9.0)
    assert one(context(10, selected=13.0, rise=12.0), P.fade_geometry()) is None
    assert one(context(10, selected=9.0, rise=12.0), P.fade_geometry()) == ("HARD_CUT", 9.0, 9.0)
    assert one(context(10, selected=7.0, rise=12.0), P.fade_geometry()) == ("CROSSFADE", 7.0, 12.0)


def test_refinements_of_a_decision(context):
    d = DECISION.format(i=14.0, o=8.0)
    df = context(10)
    assert one(df, P.false_exclusion(d, "11D", "true")) == ("HARD_CUT", 11.0, 11.0) and one(df, P.false_exclusion(d, "8.5D", "true")) == ("EXCLUSION", 14.0, 8.0)
    assert one(df, P.verified(d, "13D", "9D")) == ("EXCLUSION", 13.0, 9.0) and one(df, P.verified(d, "7D", "9D")) == ("EXCLUSION", 14.0, 8.0)
    assert one(df, P.verified(d, "null", "9D", "8.5D")) == ("EXCLUSION", 14.0, 8.5)
    island = I.with_island(context(12, [hyp(1, 16)], outs=[fall(7, 5, 7)], ins=[climb(9, 7.2, 8)]))
    assert one(island, I.left_retracted(d)) == ("EXCLUSION", 14.0, 7.0)
    h = hyp(1, 5, width=1.0)
    late = (4.0, *h[1:4], 4.5, 5.0, 6.0, 0.5, 3.0, 3.0)
    assert one(context(10, [late]), P.structure_precedes_basin("hyps[0]")) is True and one(context(10, [h]), P.structure_precedes_basin("hyps[0]")) is False


def test_interstitial_ladder(context):
    def decided(df):
        x = df.withColumn("rise", F.lit(False)).withColumn("island", F.lit(None).cast(f"struct<handoff: {HYP}, decay: {OUT}, reset: {IN}, region: struct<l: {HYP}, r: {HYP}, interior: array<{HYP}>>>")) if "island" not in df.columns else df.withColumn("rise", F.lit(False))
        return tuple(P.interstitial_geometry(R.interstitial(x)).first().interstitial)

    alone = I.with_island(context(12, [hyp(1, 16)], outs=[fall(7, 8, 10)], ins=[climb(9, 10.2, 11)], selected=11.0))
    assert decided(alone) == ("EXCLUSION", 16.0, 10.0)
    left, right = hyp(1, 5), hyp(2, 20)
    assert decided(context(12, [left, right], selected=11.0)) == ("EXCLUSION", 21.0, 5.0)  # between both handoffs
    assert decided(context(12, [hyp(3, 7, basin=0)], selected=11.0)) == ("HARD_CUT", 11.0, 11.0)


def test_shared_edge_and_handoff(spark):
    scan = spark.createDataFrame([(1, t, h, 1.0, 3.0, 0.5, 0.1 * t) for t in (9.0, 9.5, 10.5) for h in (0.5, 1.0)], "stream_id long, time_s double, horizon_s double, pre double, post double, energy double, spectral double")
    p = spark.createDataFrame([(1, 0, 10.0)], "stream_id long, k long, provisional_s double")
    assert E.shared_edge(scan, p, 2.0).first().edge_s == 9.5
    assert E.shared_edge(scan, p, 2.0, handoff=spark.createDataFrame([(1, 0, 8.0)], "stream_id long, k long, handoff_s double")).first().edge_s == 8.0
    scores = lambda rows: spark.createDataFrame([(1, float(t), s) for t, s in rows], "stream_id long, time_s double, score double")
    ref = spark.createDataFrame([(1, 0, 10.0)], "stream_id long, k long, reference_s double")
    assert E.spectral_handoff(scores([(8, 0.1), (9, 0.8), (10, 0.2), (12, 0.5), (13, 0.1)]), ref).first().handoff_s == 9.0
    assert E.spectral_handoff(scores([(8, 0.1), (9, 0.8), (10, 0.2), (12, 0.78), (13, 0.1)]), ref).count() == 0
    assert E.spectral_handoff(scores([(9, 0.4)]), ref).count() == 0
