"""python -m lodestrand AUDIO --codec mp3 --provider fixed --interval 30 --output-dir OUT: cut encoded audio into segments at frame boundaries.

Levels come from --pcm, the decoded signal (mono, 16 bit, little endian) of the same audio, which another program makes.
Without it, boundaries are cuts at the candidates themselves.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api, extend, publish
from .operators import spans, timeline
from .operators.detect import rms_levels
from .shared import checkpoint
from .sources import boundaries, framing
from .sources.live import ByteSource, open_url

LEVEL_SECONDS = 0.5
PIECE = 1 << 16


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lodestrand", description="Cut encoded audio into segments at frame boundaries.")
    p.add_argument("input", help="a file, a URL, or - for standard input")
    p.add_argument("--codec", choices=("mp3", "aac"), required=True)
    p.add_argument("--provider", choices=(*api.PROVIDERS, *extend.PROVIDERS), default="fixed")
    p.add_argument("--interval", type=float)
    p.add_argument("--boundary", type=float, action="append", default=[])
    p.add_argument("--boundaries-file")
    p.add_argument("--pcm")
    p.add_argument("--pcm-rate", type=int, default=16000)
    p.add_argument("--output-dir")
    p.add_argument("--min-tail", type=float, default=1.0)
    return p.parse_args(argv)


def pieces(spark: SparkSession, place: str) -> DataFrame:
    """stream_id 0, seq, start_offset, data of the input."""
    if place != "-" and "://" not in place:
        found = boundaries.chunks(spark, os.path.abspath(place), PIECE)
        return found.select(F.lit(0).cast("long").alias("stream_id"), "seq", "start_offset", "data")
    source = ByteSource.stdin() if place == "-" else open_url(place)
    rows, at = [], 0
    for i, data in enumerate(source.chunks(PIECE)):
        rows.append((0, i, at, data))
        at += len(data)
    return spark.createDataFrame(rows, "stream_id long, seq long, start_offset long, data binary")


def levels_of(spark: SparkSession, path: str, rate: int) -> DataFrame:
    raw = spark.read.format("binaryFile").load(os.path.abspath(path)).select(F.lit(0).cast("long").alias("stream_id"), F.col("content").alias("data"))
    at = F.explode(F.expr("sequence(0L, cast(length(data) div 2 - 1 as long))")).alias("i")
    word = F.conv(F.hex(F.concat(F.expr("substring(data, cast(i * 2 + 2 as int), 1)"), F.expr("substring(data, cast(i * 2 + 1 as int), 1)"))), 16, 10).cast("int")
    samples = raw.select("stream_id", "data", at).select("stream_id", "i", F.when(word >= 32768, word - 65536).otherwise(word).alias("sample"))
    out = rms_levels(samples, max(1, round(rate * LEVEL_SECONDS)), whole=False)
    return out.select("stream_id", "idx", (F.col("idx") * LEVEL_SECONDS).alias("start_s"), ((F.col("idx") + 1) * LEVEL_SECONDS).alias("end_s"), "rms")


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    """What was ingested, resolved and written."""
    parts = checkpoint(pieces(spark, a.input))
    frames = framing.frames(parts, a.codec)
    frames = checkpoint(frames.select("stream_id", F.col("offset").alias("idx"), F.col("time_seconds").alias("time_s"), "offset", "length", "samples", "sample_rate"))
    if a.provider == "external" and not a.boundaries_file:
        raise ValueError("the external provider needs a boundaries file")
    if a.pcm:
        resolver = "default"
        levels = checkpoint(levels_of(spark, a.pcm, a.pcm_rate))
    else:
        resolver, levels = "cut", None
    resolved, segments = api.segment(levels, frames, a.provider, a.interval, a.boundary, a.boundaries_file, a.min_tail, resolver=resolver)
    resolved, segments = checkpoint(resolved), checkpoint(segments)
    if not segments.count():  # no boundary: all of it is one segment
        segments = timeline.bounds(frames).select("stream_id", F.lit(1).alias("index"), F.col("first_offset").alias("start_offset"), "end_offset")
    answer = {
        "bytes_ingested": parts.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0], "codec": a.codec, "provider": a.provider, "interval_seconds": a.interval,
        "boundaries": [r.asDict() for r in resolved.select(F.col("k").cast("long").alias("k"), "kind", "incoming_start_s", "outgoing_end_s", "incoming_offset", "outgoing_offset").orderBy("k").collect()],
        "segments": [r.asDict() for r in segments.select(F.col("index").cast("long").alias("index"), "start_offset", "end_offset").orderBy("index").collect()],
    }
    if a.output_dir:
        os.makedirs(a.output_dir, exist_ok=True)
        publish.reconcile(a.output_dir)
        files = segments.select("stream_id", F.col("index").cast("long").alias("range"), "start_offset", "end_offset", F.format_string("segment_%04d", F.col("index").cast("int")).alias("stem"))
        written = publish.write_ranges(checkpoint(spans.spooled(parts)), files, os.path.abspath(a.output_dir), f".{a.codec}")
        paths = {r.range: r.path for r in written.collect()}
        for s in answer["segments"]:
            s["path"] = paths.get(s["index"])
    return answer


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.appName("lodestrand").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        answer = {"ok": True, **run(spark, a)}
    except Exception as e:  # the answer carries it
        code = api.classify(e)
        answer = {"ok": False, "error": {"code": code, "kind": api.KINDS[code], "message": str(e)[:500]}}
    print(json.dumps(answer, sort_keys=True))
    return 0 if answer["ok"] else 1


if __name__ == "__main__":
    sys.exit(main())
