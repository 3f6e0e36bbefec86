"""Entry points: segment a corpus of streams, and the same by a JSON request."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand import extend
from lodestrand.operators import candidates, detect, hybrid, output, timeline
from lodestrand.sources import boundaries

PROVIDERS = ("fixed", "manual", "external")
KINDS = {"invalid_request": "request", "finalize_error": "output", "write_error": "output", "io_error": "io", "internal_error": "internal"}


def segment(levels: DataFrame, frames: DataFrame, provider: str = "fixed", interval: float | None = None, times: list[float] | None = None, boundaries_file: str | None = None, min_tail: float = 1.0, resolver: str = "default") -> tuple[DataFrame, DataFrame]:
    """Resolutions and segments of all streams: candidates by the provider, resolved by the resolver: default, hybrid (quiet basins and rises before and after each candidate), cut (at the candidates, without levels), or one that is registered.

    levels(stream_id, idx, start_s, end_s, rms), frames(stream_id, idx, time_s, offset, length, samples, sample_rate).
    """
    ends = timeline.bounds(frames)
    if provider == "fixed":
        if not interval or interval <= 0:
            raise ValueError("the fixed provider needs a positive interval")
        found = candidates.fixed(ends, interval)
    elif provider == "manual":
        found = candidates.manual(ends, times or []).withColumnRenamed("n", "k")
    elif provider == "external":
        if boundaries_file is None:
            raise ValueError("the external provider needs a boundaries file")
        rows = boundaries.load(frames.sparkSession, boundaries_file)
        found = candidates.external(ends, rows).select("stream_id", F.col("n").alias("k"), F.col("time_seconds").alias("candidate_s"))
    elif provider in extend.PROVIDERS:
        found = extend.PROVIDERS[provider](ends)
    else:
        raise ValueError(f"unknown provider: {provider!r}")
    if resolver == "default":
        resolved = candidates.resolve_default(levels, frames, found)
    elif resolver == "hybrid":
        decided = hybrid.resolve(found.select("stream_id", "k", F.col("candidate_s").alias("reference_s")), detect.quiet_basins(levels), detect.energy_rises(levels))
        resolved = timeline.aligned(decided, frames)
    elif resolver == "cut":
        cuts = found.select("stream_id", "k", F.lit("HARD_CUT").alias("kind"), F.col("candidate_s").alias("incoming_start_s"), F.col("candidate_s").alias("outgoing_end_s"))
        resolved = timeline.aligned(cuts, frames)
    elif resolver in extend.RESOLVERS:
        resolved = extend.RESOLVERS[resolver](levels, frames, found)
    else:
        raise ValueError(f"unknown resolver: {resolver!r}")
    resolved = resolved.where("split_kind <> 'ERROR'")
    rows = resolved.select("stream_id", F.col("k").alias("n"), "incoming_offset", "outgoing_offset", "incoming_start_s")
    return resolved, output.segments(rows, ends.select("stream_id", "first_offset", "end_offset", "last_end_s"), min_tail)


def classify(error: Exception) -> str:
    """A code for an error of segment()."""
    if isinstance(error, (ValueError, KeyError, TypeError)):
        return "invalid_request"
    if isinstance(error, OSError) or "PATH_NOT_FOUND" in str(error):
        return "io_error"
    return "internal_error"


def segment_json(spark: SparkSession, levels: DataFrame, frames: DataFrame, request: str, out: str) -> str:
    """Run a JSON request (provider, interval, times, boundaries_file, min_tail), write `resolutions` and `segments` below out as Parquet, and answer with counts or an error, keys sorted."""
    try:
        asked = json.loads(request)
        if not isinstance(asked, dict) or set(asked) - {"provider", "interval", "times", "boundaries_file", "min_tail"}:
            raise ValueError("the request must be an object with known keys")
        resolved, parts = segment(levels, frames, **asked)
        resolved.write.mode("errorifexists").parquet(f"{out}/resolutions")
        parts.write.mode("errorifexists").parquet(f"{out}/segments")
        read = spark.read.parquet
        answer = {"ok": True, "resolutions": read(f"{out}/resolutions").count(), "segments": read(f"{out}/segments").count()}
    except Exception as e:  # the answer carries it
        code = classify(e)
        answer = {"ok": False, "error": {"code": code, "kind": KINDS[code], "message": str(e)[:500]}}
    return json.dumps(answer, sort_keys=True)
