"""What the engine reads from outside and writes there: files, streams, captures, sessions, the command line, and parts of a user's own."""

import asyncio
import http.server
import io
import json
import os
import threading

import pytest
from lodestrand import __main__ as cli
from lodestrand import api, extend, publish, radio
from lodestrand.operators import output as O
from lodestrand.operators import spans as S
from lodestrand.operators import tracks as K
from lodestrand.sources import framing as Fr
from lodestrand.sources import live, replay
from lodestrand.sources import spool as sp
from lodestrand.streaming import session as Se

from .test_engine import FRAMES, levels, mp3


def test_publish_overwrites_nothing_and_reconciles(tmp_path):
    d = str(tmp_path)
    paths = [publish.publish(d, "a", ".mp3", [b"x", b"y" * i])["path"] for i in range(3)]
    assert [os.path.basename(p) for p in paths] == ["a.mp3", "a-2.mp3", "a-3.mp3"] and open(paths[2], "rb").read() == b"xyy"
    long = publish.publish(d, "é" * 300, ".mp3", [b"z"])["path"]
    assert len(os.path.basename(long).encode()) <= 240 and long.endswith("é.mp3")
    hidden = os.path.join(d, publish.RECOVERY)
    os.link(paths[0], os.path.join(hidden, "published"))
    open(os.path.join(hidden, "lost"), "w").close()
    assert publish.reconcile(d) == (["published"], ["lost"]) and publish.reconcile(d) == ([], ["lost"])
    with pytest.raises(ValueError):
        publish.write_provenance(d, "x", [], 0, None)
    record = json.loads(open(publish.write_provenance(d, "0" * 32, [{"start": 5, "end": 9}, {"start": 0, "end": 5}], 9, (9, 12))["path"]).read())
    assert [r["start"] for r in record["ranges"]] == [0, 5] and record["tail"] == {"start": 9, "end": 12}


def test_ranges_are_written_whole_or_not_at_all(spark, tmp_path):
    data = {1: bytes(range(256)) * 9, 2: b"q" * 1000}
    chunks = S.spooled(spark.createDataFrame([(s, a, d[a : a + 333]) for s, d in data.items() for a in range(0, len(d), 333)], "stream_id long, start_offset long, data binary"), 100)
    chunks = chunks.where("stream_id = 1 or chunk > 1")
    files = spark.createDataFrame([(1, 0, 10, 1234, "one"), (1, 1, 1234, 2304, "one"), (2, 0, 150, 400, "two"), (2, 1, 500, 900, "two")], "stream_id long, range long, start_offset long, end_offset long, stem string")
    out = {(r.stream_id, r.range): r for r in publish.write_ranges(chunks, files, str(tmp_path), ".bin", 64, 100).collect()}
    assert open(out[1, 0].path, "rb").read() == data[1][10:1234] and open(out[1, 1].path, "rb").read() == data[1][1234:]
    assert out[2, 0].path is None and open(out[2, 1].path, "rb").read() == b"q" * 400
    assert sorted(n for n in os.listdir(tmp_path) if n.endswith(".bin")) == ["one-2.bin", "one.bin", "two.bin"]


def test_session_files_and_tail(spark, tmp_path):
    data = bytes(i % 251 for i in range(3000))
    chunks = S.spooled(spark.createDataFrame([(1, 0, data)], "stream_id long, start_offset long, data binary"), 256)
    splits = spark.createDataFrame([(1, 0, "a", 0, 2000, 900, 800, "EXCLUSION"), (1, 1, "b", 900, 3000, 1500, 1500, "HARD_CUT")], "stream_id long, n long, title string, previous_start long, next_end long, incoming_offset long, outgoing_offset long, split_kind string")
    receipts, ledger = publish.write_session(chunks, splits, str(tmp_path), ".mp3", 256)
    rows = {(r.role, r.start_offset): r for r in receipts.collect()}
    assert open(rows["outgoing", 0].path, "rb").read() == data[:800] and open(rows["unowned", 800].path, "rb").read() == data[800:900]
    spool = spark.createDataFrame([(1, 0, 3000)], "stream_id long, spool_start long, spool_end long")
    tail = S.finalized(ledger, spool)
    assert (tail.first().status, tail.first().tail_start) == ("TAIL", 1500)
    assert open(publish.write_terminal(chunks, tail, str(tmp_path), 256).first().path, "rb").read() == data[1500:]


def test_streaming_sink(tmp_path):
    data, freed = b"0123456789" * 10, []
    sink = publish.Sink(str(tmp_path), ".bin", lambda a, z: [data[a:z]], discard=freed.append)
    assert sink.accept(30, 35)["n_bytes"] == 30 and freed == [35]
    with pytest.raises(ValueError):
        sink.accept(20, 40)
    last = sink.finalize(100)
    assert (last["start_offset"], last["n_bytes"], sink.finalize(100)) == (35, 65, None)


def test_rows_that_break_rules(spark):
    rows = spark.createDataFrame([("HARD_CUT", 1.0, 1.0), ("CROSSFADE", 3.0, 2.0)], "kind string, incoming_start_s double, outgoing_end_s double")
    assert S.valid(rows.limit(1)).count() == 1
    with pytest.raises(Exception, match="crossfade without overlap"):
        S.valid(rows).collect()


def test_sources():
    source = live.ByteSource(io.BytesIO(b"abcdefg"))
    assert list(source.chunks(3)) == [b"abc", b"def", b"g"] and source.stream.closed
    kept = live.ByteSource(io.BytesIO(b"x"), owned=False)
    kept.close()
    assert not kept.stream.closed
    codec, pieces = live.probe(live.ByteSource(io.BytesIO(b"junk" + mp3(1) * 5)), step=700)
    assert codec == "mp3" and b"".join(pieces).startswith(b"junk")
    assert live.probe(live.ByteSource(io.BytesIO(b"nothing")))[0] is None
    assert live.metadata_interval({"ICY-MetaInt": "16"}) == 16
    for bad in ({}, {"icy-metaint": "0"}, {"icy-metaint": "x"}):
        with pytest.raises(ValueError):
            live.metadata_interval(bad)
    with pytest.raises(ValueError):
        live.open_url("file:///etc/hosts")


def test_fifo(tmp_path):
    path = str(tmp_path / "f")
    os.mkfifo(path)
    threading.Thread(target=lambda: open(path, "wb").write(b"hello"), daemon=True).start()
    assert b"".join(live.open_fifo(path).chunks()) == b"hello"


def test_async_sources():
    async def both():
        a, b = asyncio.StreamReader(), asyncio.StreamReader()
        a.feed_data(b"abcdef")
        b.feed_data(b'{"time_seconds": 1}\n\n{"time_seconds": 2.5, "source": "x"}\n')
        a.feed_eof(), b.feed_eof()
        return [x async for x in live.audio_chunks(a, 4)], [x["time_seconds"] async for x in live.boundaries(b)]

    assert asyncio.run(both()) == ([b"abcd", b"ef"], [1.0, 2.5])
    for bad in ("[1]", '{"time_seconds": true}', '{"time_seconds": 1, "source": 2}', "{"):
        with pytest.raises(ValueError, match="line 7"):
            live.boundary(bad, 7)


def test_http_stream(spark, tmp_path):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            assert self.headers["Icy-MetaData"] == "1"
            self.send_response(200)
            self.send_header("icy-metaint", "32")
            self.end_headers()
            self.wfile.write(b"s" * 5000)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        source = live.open_url(f"http://127.0.0.1:{server.server_port}/")
        assert live.metadata_interval(source.metadata) == 32 and sum(map(len, source.chunks())) == 5000
        reader = live._Reader({"url": f"http://127.0.0.1:{server.server_port}/", "chunk": "1000", "batch": "3"})
        rows, end = reader.read(reader.initialOffset())
        assert [len(r[2]) for r in rows] == [1000] * 3 and end == {"chunk": 3}
        assert len(list(reader.readBetweenOffsets({"chunk": 1}, end))) == 2
        reader.commit(end)
        assert reader.held == {} and live.HttpChunks.name() == "http_chunks"
    finally:
        server.shutdown()


def interleaved(interval=500, n=12):
    audio, out = b"".join(mp3(i % 256) for i in range(n)), b""
    for i, a in enumerate(range(0, len(audio), interval)):
        part = audio[a : a + interval]
        out += part
        if len(part) == interval:
            text = f"StreamTitle='T{i // 3}';".encode()
            out += bytes([-(-len(text) // 16)]) + text + b"\0" * (-len(text) % 16)
    return out


def test_capture_and_replay(spark, tmp_path):
    data, folder = interleaved(), str(tmp_path / "s")
    replay.write(folder, "mp3", 500, [data[i : i + 777] for i in range(0, len(data), 777)], source="test")
    assert replay.manifest(folder)["bytes"] == len(data)
    one, two, differs = replay.difference(spark, folder)
    assert one == two > 5 and differs is None
    with pytest.raises(FileExistsError):
        replay.Capture(folder, "mp3", 500)
    lines = open(folder + "/events.jsonl").read().splitlines()
    open(folder + "/events.jsonl", "w").write("\n".join([lines[0], lines[1].replace("T0", "other"), *lines[2:]]))
    assert replay.difference(spark, folder)[2] == 1
    open(folder + "/stream.bin", "ab").write(b"x")
    with pytest.raises(ValueError):
        replay.manifest(folder)


def test_session_states():
    s = Se.Session(8.0, 4.0)
    assert s.feed([("A", 0.0), ("A", 9.0)]) == []  # opens the session
    assert s.feed([("B", 20.0), ("B", 29.0)], 22.0) == []  # not settled
    again = Se.Session(8.0, 4.0).restore(s.state())
    assert again.state() == s.state()
    assert again.feed([], 24.0) == [("A", "B", "HARD_CUT", 20.0, 20.0)] and again.finish() == []
    stuck = Se.Session(8.0, 4.0, boundary=lambda title, start: None)
    assert stuck.feed([("A", 0.0), ("B", 10.0), ("C", 30.0), ("D", 50.0)], 90.0) == [] and stuck.finish() == []  # a head that can't be resolved stays
    short = Se.Session(8.0, 4.0, excluded=lambda title, lifetime: title == "ad")
    assert short.feed([("A", 0.0), ("ad", 20.0), ("B", 24.0), ("C", 50.0)], 80.0)[0] == ("A", "B", "EXCLUSION", 24.0, 20.0)


def test_sessions_stream(spark, tmp_path):
    rows = [(1, 0, "A", 0.0), (1, 1, "B", 20.0), (1, 2, "C", 45.0), (1, 3, None, 60.0), (1, 4, None, float("inf"))]
    spark.createDataFrame(rows, "stream_id long, seq long, title string, t double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("stream_id long, seq long, title string, t double").parquet(str(tmp_path / "in"))
    from lodestrand.streaming import ingest

    ingest.to_table(Se.sessions(source, 8.0, 4.0), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.outgoing, r.incoming, r.incoming_start_s) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("A", "B", 20.0), ("B", "C", 45.0)]


def test_settled_stream_ends(spark, tmp_path):
    rows = [(1, 0, 3.0, None), (1, 1, 9.0, None), (1, 2, None, 12.0), (1, 3, None, float("inf"))]
    for k in range(2):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], "stream_id long, seq long, candidate_s double, end_s double").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    from lodestrand.streaming import ingest

    source = spark.readStream.schema("stream_id long, seq long, candidate_s double, end_s double").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.to_table(ingest.settled(source, 8.0), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.candidate_s for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [3.0, 9.0]


def test_runner_and_multiplex():
    data = b"".join(mp3(i) for i in range(60))
    make = lambda: Se.Runner("mp3", 0.5, lambda a, z: [t / 2 for t in range(1, 9) if a < t / 2 <= z], lambda t, frames: (len(frames), len(frames)))
    runner = make()
    out = [t for i in range(0, len(data), 999) for t, _ in runner.feed(data[i : i + 999])]
    assert out == sorted(out) and runner.submit(0.1)[0][0] == 0.1
    assert out + [t for t, _ in runner.finish()] == [0.5, 1.0, 1.5]

    async def run():
        async def audio():
            for i in range(0, len(data), 500):
                yield data[i : i + 500]

        async def extra():
            yield 0.2
            yield 99.0

        got = []
        return await Se.multiplexed(make(), audio(), extra(), got.append), got

    left, got = asyncio.run(run())
    assert 99.0 in left and {t for t, _ in got} >= {0.2, 0.5}
    feed, titles = Se.demultiplexed(500, "mp3"), []
    stream = interleaved()
    for i in range(0, len(stream), 100):
        titles += feed(stream[i : i + 100])[1]
    assert titles[0][0] == "T0" and all(t is not None for _, t in titles)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    data = b"".join(mp3(i % 200) for i in range(400))
    (tmp_path / "a.mp3").write_bytes(data)
    a = cli.arguments([str(tmp_path / "a.mp3"), "--codec", "mp3", "--interval", "4", "--output-dir", str(tmp_path / "out")])
    answer = cli.run(spark, a)
    assert answer["bytes_ingested"] == len(data) and len(answer["segments"]) == 3
    assert b"".join(open(s["path"], "rb").read() for s in answer["segments"]) == data
    pcm = b"".join(int(3000 if i % 400 > 30 else 20).to_bytes(2, "little", signed=True) for i in range(10 * 400))
    (tmp_path / "a.pcm").write_bytes(pcm)
    a = cli.arguments([str(tmp_path / "a.mp3"), "--codec", "mp3", "--provider", "manual", "--boundary", "5", "--pcm", str(tmp_path / "a.pcm"), "--pcm-rate", "400"])
    assert len(cli.run(spark, a)["boundaries"]) == 1
    a = cli.arguments([str(tmp_path / "a.mp3"), "--codec", "mp3", "--provider", "manual"])
    assert [(s["start_offset"], s["end_offset"]) for s in cli.run(spark, a)["segments"]] == [(0, len(data))]


def test_parts_of_a_users_own(spark):
    lv = levels(spark, [50, 60, 5, 40, 70, 80, 3, 60, 50, 55] * 6)
    fr = spark.createDataFrame([(1, i, i * 0.5, i * 100, 100, 22050, 44100) for i in range(60)], FRAMES)
    extend.register_provider("thirds", lambda ends: ends.selectExpr("stream_id", "1L as k", "last_end_s / 3 as candidate_s"))
    try:
        assert isinstance(extend.PROVIDERS["thirds"], extend.BoundaryProvider)
        assert api.segment(lv, fr, "thirds")[0].count() == 1
        assert api.segment(lv, fr, "thirds", resolver="hybrid")[0].count() <= 1
        with pytest.raises(ValueError):
            extend.register_provider("thirds", print)
        with pytest.raises(TypeError):
            extend.register_resolver("x", 5)
        with pytest.raises(ValueError):
            api.segment(lv, fr, "thirds", resolver="nobody")
    finally:
        del extend.PROVIDERS["thirds"]


def test_spool_folds(spark):
    pieces = spark.createDataFrame([(1, 0, b"a" * 250), (1, 250, b"b" * 10), (1, 260, b"c" * 500)], "stream_id long, start_offset long, data binary")
    rows = {r.chunk: r for r in S.spooled(pieces, 100).collect()}
    assert b"".join(bytes(rows[i].data) for i in sorted(rows)) == b"a" * 250 + b"b" * 10 + b"c" * 500 and [len(rows[i].data) for i in sorted(rows)] == [100] * 7 + [60]
    left = S.inventory(S.spooled(pieces, 100).where("chunk <> 3")).first()
    assert (left.n_chunks, left.contiguous) == (7, False)
    assert O.ledger(spark.createDataFrame([(1, 1, 0, 5)], "stream_id long, seq long, start_offset long, end_offset long")).first().status == "OK"
    t = spark.createDataFrame([(1, 0, 10, 10), (1, 1, 5, 20), (1, 2, 30, 25)], "stream_id long, n long, outgoing_end long, incoming_start long")
    assert [r.n for r in K.written(t).collect()] == [0, 2]


def test_spool_on_a_disk(tmp_path):
    folder = str(tmp_path / "s")
    spool = sp.Spool(folder, 100, most=1000, reserve=0)
    data = bytes(i % 251 for i in range(650))
    assert spool.append(data[:333]) == (0, 333) and spool.append(data[333:], at=333) == (333, 650)
    assert b"".join(spool.read(95, 512)) == data[95:512] and len(sp.inventory(folder)) == 7
    with pytest.raises(ValueError):
        spool.append(b"x", at=700)
    with pytest.raises(OSError):
        spool.append(b"x" * 400)
    spool.discard_before(250)
    assert len(sp.inventory(folder)) == 5 and b"".join(spool.read(250, 310)) == data[250:310]
    with pytest.raises(ValueError):
        list(spool.read(249, 260))
    with pytest.raises(FileExistsError):
        sp.Spool(folder, 100)
    with pytest.raises(OSError):
        sp.Spool(str(tmp_path / "t"), 100, reserve=1 << 60).append(b"x")


def test_radio_session_and_its_replay(spark, tmp_path):
    data, n = interleaved(2000, 400), 997
    capture = replay.Capture(str(tmp_path / "c"), "mp3", 2000)
    answer = radio.run([data[i : i + n] for i in range(0, len(data), n)], "mp3", 2000, str(tmp_path / "o"), 0.2, 0.5, capture, spool_size=4096)
    audio = b"".join(mp3(i % 256) for i in range(400))
    assert len(answer["tracks"]) > 5 and answer["tracks"][0]["title"] == "T0"
    got = b"".join(open(t["path"], "rb").read() for t in [*answer["tracks"], answer["tail"]])
    assert got == audio and answer["tail"]["end_offset"] == len(audio)
    again = radio.replayed(spark, str(tmp_path / "c"))
    assert again["equal"] and again["captured"] > 10
