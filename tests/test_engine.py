"""Golden cases of the engine's operators, and properties that hold for any input."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestrand import api
from lodestrand.functions import text as X
from lodestrand.functions import vectors as V
from lodestrand.operators import candidates as C
from lodestrand.operators import detect as D
from lodestrand.operators import edges as E
from lodestrand.operators import evidence as Ev
from lodestrand.operators import output as O
from lodestrand.operators import rank as R
from lodestrand.operators import routing as Ro
from lodestrand.operators import sessions as S
from lodestrand.operators import timeline as T
from lodestrand.sources import boundaries as J
from lodestrand.sources import framing as Fr
from lodestrand.streaming import ingest

LEVELS = "stream_id long, idx long, start_s double, end_s double, rms double"
FRAMES = "stream_id long, idx long, time_s double, offset long, length int, samples int, sample_rate int"


def levels(spark, values, seconds=0.5, stream=1):
    return spark.createDataFrame([(stream, i, i * seconds, (i + 1) * seconds, float(v)) for i, v in enumerate(values)], LEVELS)


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(1, 0, 10.0, 1000, 417, 1152, 44100), (1, 1, 10.026, 1417, 417, 1152, 44100), (1, 2, 10.052, 1834, 417, 1152, 44100)]
    return spark.createDataFrame(rows, FRAMES)


def test_basin(spark):
    row = D.adaptive_basins(levels(spark, [1000] * 30 + [100, 80, 70, 90, 120] + [500] * 8 + [1000] * 20)).collect()
    assert len(row) == 1 and (row[0].start_idx, row[0].minimum_idx) == (30, 32) and row[0].recovery_idx >= 35 and row[0].depth < 0.10


def test_structural_peak(spark):
    wave = [10000 if i // (10 if i < 600 else 2) % 2 else -10000 for i in range(1200)]
    pcm = spark.createDataFrame([(1, i, s) for i, s in enumerate(wave)], "stream_id long, i long, sample int")
    peaks = D.spaced_peaks(D.novelty(D.structural_features(pcm, 50), 4), 0.05, 2.0, 0.5).collect()
    assert any(abs(p.time_s - 6.0) <= 0.5 for p in peaks)


@pytest.mark.parametrize(
    "kind,incoming,outgoing,want",
    [
        ("EXCLUSION", 10.026204, 10.026, ("HARD_CUT", 1417, 1417)),
        ("CROSSFADE", 10.0, 10.05, ("CROSSFADE", 1000, 1834)),
        ("CROSSFADE", 10.0, 10.01, ("ERROR", None, None)),
        ("EXCLUSION", 10.0, 10.05, ("ERROR", None, None)),
        ("HARD_CUT", 10.013, 10.013, ("HARD_CUT", 1000, 1000)),
        ("HARD_CUT", 9.9, 9.9, ("ERROR", None, None)),
    ],
)
def test_align(spark, frames, kind, incoming, outgoing, want):
    d = spark.createDataFrame([(1, kind, incoming, outgoing)], "stream_id long, kind string, incoming_start_s double, outgoing_end_s double")
    r = T.aligned(d, frames).first()
    assert (r.split_kind, r.incoming_offset, r.outgoing_offset) == want


def test_as_of_joins_against_scans(spark):
    r = random.Random(1)
    rows, probes = [], []
    for s in range(3):
        offset, t = 0, 0.0
        for i in range(60):
            n = r.randrange(1, 40)
            rows.append((s, i, t, offset, n, 576, 44100))
            offset, t = offset + n, t + r.choice([0.25, 1.0, 40.0])
        probes += [(s, k, r.randrange(-5, offset + 9), r.choice([0.0, t, t / 2, 13.1, 0.125])) for k in range(40)]
    f = spark.createDataFrame(rows, FRAMES)
    p = spark.createDataFrame(probes, "stream_id long, k long, at long, t double")
    of = lambda s: [x for x in rows if x[0] == s]
    hit = lambda df: {(x.stream_id, x.k): None if x.hit is None else x.hit.idx for x in df.collect()}
    back, ahead, inside, near = hit(T.at_or_before(p, f, "at")), hit(T.at_or_after(p, f, "at")), hit(T.containing(p, f, "at")), hit(T.nearest(p, f, "t"))
    for s, k, at, t in probes:
        own = of(s)
        assert back[s, k] == max([x[1] for x in own if x[3] <= at], default=0)
        assert ahead[s, k] == min([x[1] for x in own if x[3] + x[4] > at], default=None)
        assert inside[s, k] == next((x[1] for x in own if x[3] <= at < x[3] + x[4]), None)
        gap = min(abs(x[2] - t) for x in own)
        assert abs(own[near[s, k]][2] - t) == gap and own[near[s, k]][2] == min(x[2] for x in own if abs(x[2] - t) == gap)


def test_match_prefers_a_much_quieter_minimum_before(spark):
    c = spark.createDataFrame([(1, 10.0)], "stream_id long, candidate_s double")
    m = lambda rows: C.matched(c, spark.createDataFrame([(1, *r) for r in rows], "stream_id long, minimum_s double, rms double")).collect()
    assert m([(10.5, 100.0), (8.5, 10.0)])[0].acoustic_s == 8.5
    assert m([(10.5, 100.0), (8.5, 11.0)])[0].acoustic_s == 10.5
    assert m([(10.5, 100.0), (8.5, 0.0)])[0].acoustic_s == 8.5
    assert m([(18.5, 1.0)]) == []


@pytest.mark.parametrize("acoustic,want", [(5.0, ("CROSSFADE", 5.0, 10.0)), (14.0, ("HARD_CUT", 14.0, 14.0)), (12.0, ("HARD_CUT", 10.0, 10.0)), (7.0, ("HARD_CUT", 7.0, 7.0))])
def test_policy(spark, acoustic, want):
    r = C.decided(spark.createDataFrame([(1, 10.0, acoustic, 1.0)], "stream_id long, candidate_s double, acoustic_s double, acoustic_rms double")).first()
    assert (r.kind, r.incoming_start_s, r.outgoing_end_s) == want


@pytest.mark.parametrize("rows", [[(1.0, 0.9, 0.1), (2.0, 0.8, 0.8), (3.0, 0.1, 0.9)], [(3.0, 0.8, 0.9), (2.0, 0.9, 0.8)]])
def test_minimax(spark, rows):
    df = spark.createDataFrame([(1, *r) for r in rows], "stream_id long, time_s double, family_rrf double, forward_novelty double")
    assert R.minimax(df).first().time_s == 2.0


def test_union(spark):
    ref = spark.createDataFrame([(1, 0, 10.0)], "stream_id long, k long, reference_s double")
    basins = spark.createDataFrame([(1, 5.0), (1, 9.5), (1, 2.0)], "stream_id long, time_s double")
    series = spark.createDataFrame([(1, t, s) for t, s in ((4.0, 0.1), (5.0, 0.9), (6.0, 0.2), (7.0, 0.3))], "stream_id long, time_s double, strength double")
    assert sorted((r.time_s, r.sources) for r in R.union_candidates(ref, basins, series).collect()) == [(5.0, "BASIN+D2"), (7.0, "D2")]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    out = df.select(V.cosine_distance(F.col("a"), F.col("b")), V.js_divergence(F.col("a"), F.col("b")), V.profile_distance(F.col("a"), F.col("b"))).collect()
    assert [round(r[0], 9) for r in out] == [1.0, 0.0, 0.0, 0.0] and [round(r[1], 9) for r in out] == [1.0, 0.0, 1.0, 0.0]
    assert out[0][2] == pytest.approx(2**0.5)


def test_clusters_hold_what_is_near_their_first(spark):
    rows = [(1, t, "BASIN" if t != 4.0 else "STRUCTURAL", 0.05, 0.5, t - 1, t + 1) for t in (1.0, 3.0, 4.0, 4.5, 9.0)]
    df = spark.createDataFrame(rows, "stream_id long, time_s double, source string, depth double, strength double, start_s double, recovery_s double")
    out = Ev.clusters(df).orderBy("hyp_id").collect()
    assert [(r.time_s, r.n_basin, r.n_structural) for r in out] == [(3.0, 2, 1), (4.5, 1, 0), (9.0, 1, 0)]
    assert Ev.confidence(Ev.clusters(df), F.lit(0.2)).where("confidence = 'HIGH'").count() == 1


ROUTE = {k: False for k in ("symmetric_insert", "asymmetric_insert", "island_region", "island", "floor_handoff", "floor_only", "rise", "stale", "absorbed", "two_sided", "local_complete", "shared_handoff")} | {k: 0 for k in ("n_basins", "n_reconciled", "n_handoffs")}


@pytest.mark.parametrize(
    "given,want",
    [
        ({}, "AMBIGUOUS"),
        ({"local_complete": True, "shared_handoff": True}, "HARD_CUT"),
        ({"local_complete": True, "shared_handoff": True, "rise": True}, "AMBIGUOUS"),
        ({"floor_only": True}, "FADE"),
        ({"n_handoffs": 2, "floor_only": True}, "INTERSTITIAL"),
        ({"rise": True, "n_basins": 1}, "FADE"),
        ({"rise": True, "n_basins": 1, "stale": True}, "AMBIGUOUS"),
        ({"rise": True, "n_basins": 1, "n_handoffs": 2}, "INTERSTITIAL"),
        ({"rise": True, "n_basins": 1, "n_handoffs": 2, "n_reconciled": 1, "two_sided": True}, "FADE"),
        ({"rise": True, "n_basins": 1, "n_handoffs": 2, "n_reconciled": 1, "two_sided": True, "absorbed": True}, "INTERSTITIAL"),
        ({"island": True, "floor_handoff": True}, "FADE"),
        ({"island_region": True, "floor_handoff": True}, "INTERSTITIAL"),
        ({"asymmetric_insert": True, "island_region": True}, "BOUNDED_INSERT"),
    ],
)
def test_route(spark, given, want):
    assert Ro.routed(spark.createDataFrame([ROUTE | given])).first().kind == want


def test_multisignal_decision(spark):
    df = spark.createDataFrame([(8.0, 10.0, None), (8.0, 10.0, 11.0), (8.0, 10.0, 15.0), (12.0, 10.0, 11.0)], "s double, r double, x double")
    out = [r[0] and tuple(r[0]) for r in df.select(Ro.multisignal_decision(F.col("s"), F.col("r"), F.col("x"))).collect()]
    assert out == [("HARD_CUT", 8.0, 8.0), ("CROSSFADE", 8.0, 11.0), ("HARD_CUT", 8.0, 8.0), None]


def test_plans_and_coverage(spark):
    s = spark.createDataFrame([(1, 100, 900, "EXCLUSION", 500, 400), (2, 100, 900, "CROSSFADE", 400, 500), (3, 100, 900, "HARD_CUT", 100, 100)], "stream_id long, previous_start long, next_end long, split_kind string, incoming_offset long, outgoing_offset long")
    out = sorted((r.stream_id, r.start_offset, r.end_offset, r.role) for r in O.planned(s, crossfade_unowned=True).collect())
    assert out == [(1, 100, 400, "outgoing"), (1, 400, 500, "unowned"), (1, 500, 900, "incoming"), (2, 100, 400, "outgoing"), (2, 400, 500, "unowned"), (2, 500, 900, "incoming")]
    assert [(r.start_offset, r.end_offset) for r in O.planned(s.where("stream_id = 2")).orderBy("start_offset").collect()] == [(100, 500), (400, 900)]
    rows = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 5, 9), (1, 3, 12, 20), (1, 4, 15, 25), (1, 5, 3, 4)], "stream_id long, seq long, start_offset long, end_offset long")
    assert [r.status for r in O.ledger(rows).orderBy("seq").collect()] == ["OK", "OK", "GAP", "OVERLAP", "INSIDE"]


def test_segments_are_contiguous(spark):
    rows = spark.createDataFrame([(1, 1, 40, 40, 4.0), (1, 2, 80, 80, 8.0)], "stream_id long, n long, incoming_offset long, outgoing_offset long, incoming_start_s double")
    ends = spark.createDataFrame([(1, 0, 100, 10.0)], "stream_id long, first_offset long, end_offset long, last_end_s double")
    get = lambda tail: [(r["index"], r.start_offset, r.end_offset) for r in O.segments(rows, ends, tail).orderBy("index").collect()]
    assert get(1.0) == [(1, 0, 40), (2, 40, 80), (3, 80, 100)]
    assert get(2.5) == [(1, 0, 40), (2, 40, 100)]


def mp3(payload=0, bitrate=9, pad=0):
    word = 0x7FF << 21 | 3 << 19 | 1 << 17 | 1 << 16 | bitrate << 12 | pad << 9
    length = 144000 * Fr.KBPS_1[bitrate - 1] // 44100 + pad
    return word.to_bytes(4, "big") + bytes([payload]) * (length - 4)


def adts(length=40, rate=4):
    return bytes([0xFF, 0xF1, 1 << 6 | rate << 2, length >> 11 & 3, length >> 3 & 255, (length & 7) << 5 | 31, 0]) + b"\1" * (length - 7)


@pytest.mark.parametrize("codec,data", [("mp3", b"junk" + mp3(1) + mp3(2, 14) + b"\xff" + mp3(3, 5, 1) + mp3(4)[:50]), ("aac", b"xx" + adts() + adts(99) + b"\xff\xf1" + adts(64))])
def test_frames_do_not_depend_on_the_pieces(codec, data):
    whole = Fr.FrameScan(codec).feed(data)
    assert len(whole) == 3
    r = random.Random(5)
    for _ in range(30):
        scan, out, at = Fr.FrameScan(codec), [], 0
        while at < len(data):
            n = r.randrange(1, 200)
            out += scan.feed(data[at : at + n])
            at += n
        assert out == whole


def test_header_expressions_agree_with_the_scan(spark):
    r = random.Random(9)
    heads = [mp3(0, r.randrange(1, 15), r.randrange(2))[:4] for _ in range(20)] + [bytes([255, 224 | r.randrange(32), r.randrange(256), r.randrange(256)]) for _ in range(300)]
    rows = [(i, int.from_bytes(h, "big")) for i, h in enumerate(heads)]
    out = {x.i: x.h and tuple(x.h) for x in spark.createDataFrame(rows, "i long, w long").select("i", Fr.mp3_header(F.col("w")).alias("h")).collect()}
    assert all(out[i] == Fr.parse_mp3(h, 0) for i, h in enumerate(heads))
    heads = [adts(r.randrange(7, 8000), r.randrange(13))[:7] for _ in range(20)] + [bytes([255, r.choice([0xF0, 0xF1, 0xF9]), *(r.randrange(256) for _ in range(5))]) for _ in range(300)]
    rows = [(i, int.from_bytes(h[:4], "big"), int.from_bytes(h[4:], "big")) for i, h in enumerate(heads)]
    out = {x.i: x.h and tuple(x.h) for x in spark.createDataFrame(rows, "i long, a long, b long").select("i", Fr.adts_header(F.col("a"), F.col("b")).alias("h")).collect()}
    assert all(out[i] == Fr.parse_adts(h, 0) for i, h in enumerate(heads))


def test_demux_does_not_depend_on_the_pieces():
    block = "StreamTitle='A é - B';StreamUrl='';".encode()
    block += b"\0" * (-len(block) % 16)
    data = b"a" * 32 + bytes([len(block) // 16]) + block + b"b" * 32 + b"\0" + b"c" * 32 + bytes([1]) + b"StreamTitle=' ';" + b"d" * 5
    want = (b"a" * 32 + b"b" * 32 + b"c" * 32 + b"d" * 5, [("A é - B", 32)])
    for n in (1, 3, 16, 33, 500):
        demux, audio, events = Fr.Demux(32), b"", []
        for i in range(0, len(data), n):
            a, e = demux.feed(data[i : i + n])
            audio, events = audio + a, events + e
        assert (audio, events) == want


def test_codec_is_detected_if_only_one_has_a_run(spark):
    rows = [(1, "mp3", i * 10, 10, 44100) for i in range(3)] + [(1, "aac", 5, 3, 44100)] + [(2, c, i * 10, 10, 44100) for c in ("mp3", "aac") for i in range(3)] + [(3, "mp3", i * 11, 10, 44100) for i in range(5)]
    out = {r.stream_id: r.codec for r in Fr.detected_codec(spark.createDataFrame(rows, "stream_id long, codec string, offset long, length int, sample_rate int")).collect()}
    assert out == {1: "mp3", 2: None, 3: None}


def test_boundary_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"time_seconds": 1}, {"time_seconds": 2.5, "source": "cue", "reference_offset": 7}]))
    (tmp_path / "b.jsonl").write_text('{"time_seconds": 1}\n\n{"time_seconds": 2.5, "source": "cue", "reference_offset": 7}\n')
    want = [(1.0, "external", None), (2.5, "cue", 7)]
    for name in ("a.json", "b.jsonl"):
        assert [tuple(r) for r in J.load(spark, str(tmp_path / name)).orderBy("time_seconds").collect()] == want
    (tmp_path / "c.jsonl").write_text('{"time_seconds": true}\n')
    with pytest.raises(Exception, match="invalid boundary"):
        J.load(spark, str(tmp_path / "c.jsonl")).collect()
    with pytest.raises(ValueError):
        J.load(spark, "x.csv")


def test_chunks(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(bytes(range(256)) * 3)
    out = J.chunks(spark, str(tmp_path / "f.bin"), 100).orderBy("seq").collect()
    assert b"".join(bytes(r.data) for r in out) == bytes(range(256)) * 3 and [r.start_offset for r in out] == list(range(0, 768, 100))


def test_titles_and_names(spark):
    df = spark.createDataFrame([("Élan – Straße 2!",), ("a/b: c  ?",), (" ._-",), (None,)], "t string")
    out = df.select(X.normal_title(F.col("t")), X.safe_stem(F.col("t"))).collect()
    assert [tuple(r) for r in out] == [("elan strasse 2", "Élan – Straße 2!"), ("a b c", "a_b_ c"), ("", "track"), (None, None)]
    text = spark.createDataFrame([("aéz",)], "t string")
    assert [text.select(X.utf8_prefix(F.col("t"), n)).first()[0] for n in (0, 1, 2, 3, 4, 9)] == ["", "a", "a", "aé", "aéz", "aéz"]
    urls = spark.createDataFrame([("http://h.x/p.mp3",), ("https://h.x:443/p.mp3",), ("http://h.x:8000/p.mp3",), ("http://u@h.x/p.mp3",), ("http://h.x/p.mp3?q",), (None,)], "u string")
    assert [r[0] for r in urls.select(X.metadata_order(F.col("u"), "auto", "h.x", "/p.mp3")).collect()] == ["title-artist", "title-artist"] + ["preserve"] * 4
    assert spark.range(1).select(X.untracked_label(F.lit(1.2345))).first()[0] == "untracked_000000001234"
    types = spark.createDataFrame([("Audio/AACP; x",), ("audio/mpeg",), ("text/html",)], "c string")
    assert [r[0] for r in types.select(X.audio_codec(F.col("c"))).collect()] == ["aac", "mp3", None]


def test_title_lifetimes_batch_and_stream(spark, tmp_path):
    r = random.Random(4)
    rows, t = [], 0
    for i in range(60):
        t += r.choice([1, 3, 9])
        rows.append((r.randrange(2), i, r.choice("ABC"), t))
    events = spark.createDataFrame(rows, "stream_id long, seq long, title string, t long")
    batch = {(x.stream_id, x.title, x.start_t, x.kind) for x in S.lifetimes(events, 8).collect()}
    for k in range(3):
        events.where(F.floor(F.col("seq") / 20) == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    source = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.to_table(ingest.titles(source, 8), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(x.stream_id, x.title, int(x.start_t), x.what) for x in out if x.what != "TRACK"} == batch


def test_frames_batch_and_stream(spark, tmp_path):
    data = {1: mp3(1) + mp3(2, 14) + mp3(3), 2: b"zz" + mp3(4, 5) + mp3(5)}
    rows = [(s, i, d[a : a + 300]) for s, d in data.items() for i, a in enumerate(range(0, len(d), 300))]
    chunks = spark.createDataFrame(rows, "stream_id long, seq long, data binary")
    want = sorted(map(tuple, Fr.frames(chunks, "mp3").collect()))
    assert len(want) == 5
    for k in range(2):
        chunks.where(F.col("seq") < 2 if k == 0 else F.col("seq") >= 2).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    source = spark.readStream.schema(chunks.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.to_table(ingest.frames(source, "mp3"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want


def test_settle_queue_and_tracker():
    q = ingest.SettleQueue(8.0)
    assert q.feed([5.0, 1.0], 9.5) == [1.0] and q.feed([0.5], None) == [0.5] and q.flush() == [5.0]
    t = ingest.TitleTracker(8.0)
    assert t.feed("A", 0) == [] and t.feed("A", 9) == [("TRACK", "A", 0, 9)] and t.feed("B", 10) == [("HARD_CUT", "A", 0, 10)]
    assert t.clock(12) == [] and t.clock(18) == [("TRACK", "B", 10, 18)]
    with pytest.raises(ValueError):
        t.feed("C", 1)


def test_prefix_means_against_scans(spark):
    lv = levels(spark, range(20))
    spans = spark.createDataFrame([(1, a / 4, b / 4) for a in range(-4, 44, 7) for b in range(a + 1, 46, 9)], "stream_id long, from_s double, to_s double")
    for r in E.prefix_means(lv, spans).collect():
        own = [i for i in range(20) if r.from_s <= i * 0.5 + 0.25 < r.to_s]
        assert r.n == len(own) and (r.mean_rms == pytest.approx(sum(own) / len(own)) if own else r.mean_rms is None)


def test_api(spark, tmp_path):
    values = [50, 60, 5, 40, 70, 80, 3, 60, 50, 55] * 6
    lv = levels(spark, values)
    fr = spark.createDataFrame([(1, i, i * 0.5, i * 100, 100, 22050, 44100) for i in range(60)], FRAMES)
    answer = json.loads(api.segment_json(spark, lv, fr, '{"provider": "fixed", "interval": 10}', str(tmp_path / "o")))
    assert answer["ok"] and answer["segments"] in (answer["resolutions"], answer["resolutions"] + 1)
    parts = spark.read.parquet(str(tmp_path / "o/segments")).orderBy("index").collect()
    assert parts[0].start_offset == 0 and parts[-1].end_offset == 6000
    assert json.loads(api.segment_json(spark, lv, fr, '{"provider": "x"}', str(tmp_path / "p")))["error"]["code"] == "invalid_request"
    assert json.loads(api.segment_json(spark, lv, fr, "[]", str(tmp_path / "p")))["ok"] is False


HYP = "struct<time_s: double, hyp_id: long, n_basin: int, n_structural: int, start_s: double, minimum_s: double, recovery_s: double, novelty: double>"


def hyp(i, t, basin=1, structural=1, width=1.0, novelty=0.5):
    edges = (t - width, t, t + width) if basin else (None, None, None)
    return (t, i, basin, structural, *edges, novelty if structural else None)


@pytest.mark.parametrize(
    "reference,hyps,want",
    [
        (12.0, [hyp(1, 10.0), hyp(2, 12.5, basin=0), hyp(3, 20.0)], ("HARD_CUT", 12.5, 12.5)),  # a bridge nearest to the reference
        (10.5, [hyp(1, 10.0), hyp(2, 16.0, basin=0), hyp(3, 20.0)], ("EXCLUSION", 20.0, 10.0)),  # the region itself
        (12.0, [hyp(0, 2.0), hyp(4, 5.0, basin=0), hyp(1, 10.0), hyp(3, 20.0)], ("EXCLUSION", 20.0, 2.0)),  # from the one before, over structure alone
        (12.0, [hyp(0, 2.0), hyp(4, 5.0, structural=0), hyp(1, 10.0), hyp(3, 20.0)], ("EXCLUSION", 20.0, 10.0)),
        (12.0, [hyp(1, 10.0), hyp(2, 13.0, basin=0)], ("EXCLUSION", 13.0, 11.0)),  # one-sided
        (12.0, [hyp(1, 11.5), hyp(2, 13.0, basin=0)], None),  # the right one is farther
    ],
)
def test_insert_geometry(spark, reference, hyps, want):
    from lodestrand.operators import specialists as P

    c = spark.createDataFrame([(1, 0, reference, hyps)], f"stream_id long, k long, reference_s double, hyps array<{HYP}>")
    out = P.unpacked(P.insert_geometry(Ev.asymmetric_regions(Ev.symmetric_regions(c)), F.lit(False)), "insert").collect()
    assert [(r.kind, r.incoming_start_s, r.outgoing_end_s) for r in out] == ([want] if want else [])


def test_supported_exclusion(spark):
    from lodestrand.operators import specialists as P

    rows = [(1, s, s, [hyp(1, 10.0), hyp(2, 20.0)]) for s in (12.0, 18.0, 25.0)] + [(2, 12.0, 12.0, [hyp(1, 10.0), hyp(2, 20.0, basin=0)])]
    c = spark.createDataFrame(rows, f"stream_id long, selected_s double, reference_s double, hyps array<{HYP}>")
    out = P.unpacked(P.supported_exclusion(c, "selected_s"), "exclusion").orderBy("selected_s").collect()
    assert [(r.selected_s, r.outgoing_end_s, r.incoming_start_s) for r in out] == [(12.0, 10.0, 21.0), (18.0, 18.0, 21.0)]
