"""Captured sessions: the raw bytes as they came, what was read from them, and a manifest; and their replay, which must give the same events."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import framing

SCHEMA = 1
NAMES = ("manifest.json", "stream.bin", "events.jsonl")


class Capture:
    """Writes a session into a new folder; no file is overwritten. close() writes the manifest, so a folder without one is incomplete."""

    def __init__(self, folder: str, codec: str, interval: int, **about):
        os.makedirs(folder, exist_ok=True)
        self.folder, self.about = folder, {"schema": SCHEMA, "codec": codec, "metaint": interval, **about}
        self.stream, self.events = (open(os.path.join(folder, n), "x" + m) for n, m in (("stream.bin", "b"), ("events.jsonl", "")))
        self.bytes = self.count = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.bytes += len(data)

    def event(self, title: str, audio_offset: int, audio_time_seconds: float | None) -> None:
        self.events.write(json.dumps(event_record(title, audio_offset, audio_time_seconds), sort_keys=True) + "\n")
        self.count += 1

    def close(self) -> None:
        self.stream.close()
        self.events.close()
        with open(os.path.join(self.folder, "manifest.json"), "x") as out:
            json.dump(self.about | {"bytes": self.bytes, "events": self.count}, out, sort_keys=True)


def event_record(title: str, audio_offset: int, audio_time_seconds: float | None) -> dict:
    return {"title": title, "audio_offset": audio_offset, "audio_time_seconds": audio_time_seconds}


def manifest(folder: str) -> dict:
    """The manifest of a captured session, checked."""
    with open(os.path.join(folder, "manifest.json")) as lines:
        found = json.load(lines)
    if not isinstance(found, dict) or found.get("schema") != SCHEMA:
        raise ValueError("the manifest is of another schema")
    interval = found.get("metaint")
    if isinstance(interval, bool) or not isinstance(interval, int) or interval <= 0:
        raise ValueError("metaint must be an integer above 0")
    size = os.path.getsize(os.path.join(folder, "stream.bin"))
    if size != found.get("bytes"):
        raise ValueError(f"the stream has {size} bytes, the manifest says {found.get('bytes')}")
    return found


def captured(spark: SparkSession, folder: str) -> DataFrame:
    """seq, title, audio_offset, audio_time_seconds of the events as they were captured."""
    schema = "title string, audio_offset long, audio_time_seconds double"
    with open(os.path.join(folder, "events.jsonl")) as lines:
        rows = [(i, *(json.loads(line)[k] for k in ("title", "audio_offset", "audio_time_seconds"))) for i, line in enumerate(lines) if line.strip()]
    return spark.createDataFrame(rows, f"seq long, {schema}")


def chunks(spark: SparkSession, folder: str, size: int = 65536) -> DataFrame:
    """stream_id 0, seq, data of the captured bytes."""
    files = spark.read.format("binaryFile").load(os.path.join(folder, "stream.bin")).where("length > 0")
    return files.select(F.lit(0).cast("long").alias("stream_id"), "content", F.explode(F.expr(f"sequence(0L, length - 1, {size}L)")).alias("a")).select(
        "stream_id", (F.col("a") / size).cast("long").alias("seq"), F.expr(f"substring(content, cast(a as int) + 1, {size})").alias("data")
    )


def replayed(spark: SparkSession, folder: str) -> DataFrame:
    """seq, title, audio_offset, audio_time_seconds as the captured bytes give them: titles between the audio, timed by the frame that ends after them."""
    about = manifest(folder)
    parts = framing.demuxed(chunks(spark, folder), about["metaint"])
    frames = framing.frames(parts.select("stream_id", "seq", F.col("audio").alias("data")), about["codec"])
    events = parts.select("stream_id", "seq", F.posexplode("events").alias("n", "e")).select("stream_id", "seq", "n", "e.title", "e.audio_offset")
    from lodestrand.operators import timeline

    ordered = frames.select("stream_id", F.col("offset").alias("idx"), "offset", "length", F.col("time_seconds").alias("time_s"))
    timed = timeline.at_or_after(events, ordered, "audio_offset")
    from pyspark.sql import Window

    nth = (F.row_number().over(Window.partitionBy("stream_id").orderBy("seq", "n")) - 1).cast("long")
    return timed.select(nth.alias("seq"), "title", "audio_offset", F.col("hit.time_s").alias("audio_time_seconds"))


def difference(spark: SparkSession, folder: str) -> tuple[int, int, int | None]:
    """How many events were captured and replayed, and the place of the first that differs (null: none)."""
    one, two = (df.select(F.col("seq").alias("pos"), F.struct("title", "audio_offset", F.round("audio_time_seconds", 6).alias("t")).alias(n)) for df, n in ((captured(spark, folder), "a"), (replayed(spark, folder), "b")))
    row = one.join(two, "pos", "full_outer").agg(F.count("a"), F.count("b"), F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("pos")))).first()
    return row[0], row[1], row[2]


def write(folder: str, codec: str, interval: int, pieces: Iterable[bytes], **about) -> None:
    """Capture pieces, with the events that are in them."""
    capture, demux, scan, frames, waiting = Capture(folder, codec, interval, **about), framing.Demux(interval), framing.FrameScan(codec), [], []
    for piece in pieces:
        capture.write(piece)
        audio, events = demux.feed(piece)
        waiting += events
        frames += scan.feed(audio)
        while waiting and frames:
            title, offset = waiting[0]
            frames = [f for f in frames if f[1] + f[2] > offset]
            if not frames:
                break
            capture.event(title, offset, frames[0][5])
            waiting.pop(0)
    for title, offset in waiting:
        capture.event(title, offset, None)
    capture.close()
