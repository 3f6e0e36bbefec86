"""Features of PCM as Arrow kernels. What compares them (scales, variability, regimes, edges) is relational: see rank and edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand import on_workers
from lodestrand.functions import signal as K
from lodestrand.functions import vectors as V

BY = "stream_id"


def _kernel(pcm: DataFrame, schema: str, rows_of, by: str = BY) -> DataFrame:
    """rows_of(samples) -> rows for each row of pcm(by, data binary: mono 16-bit)."""
    on_workers()
    names = [by, *(f.strip().split(" ")[0] for f in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, *row) for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if data is not None for row in rows_of(K.from_pcm(data))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[] for _ in names], types)], names)

    out = pcm.sparkSession.createDataFrame([], f"{by} {dict(pcm.dtypes)[by]}, {schema}").schema
    from pyspark.sql.pandas.types import to_arrow_schema

    types = [f.type for f in to_arrow_schema(out)]
    return pcm.select(by, "data").mapInArrow(run, out)


def block_vectors(pcm: DataFrame, rate: int, seconds: float, by: str = BY) -> DataFrame:
    """by, idx, vec: the 25 numbers of each whole block."""
    size = max(1, round(rate * seconds))
    return _kernel(pcm, "idx long, vec array<double>", lambda s: [(i, K.block_vector(s[i * size : (i + 1) * size], rate).tolist()) for i in range(len(s) // size)], by)


def profiles(pcm: DataFrame, rate: int, seconds: float, by: str = BY) -> DataFrame:
    """by, idx, vec: centroid, spread, entropy, flatness and roll-off of each whole block."""
    size = max(1, round(rate * seconds))
    return _kernel(pcm, "idx long, vec array<double>", lambda s: [(i, K.profile(s[i * size : (i + 1) * size], rate).tolist()) for i in range(len(s) // size)], by)


def band_features(pcm: DataFrame, rate: int, by: str = BY) -> DataFrame:
    """by, idx, center_s, rms, vec (shares of bands) of each short frame."""

    def rows(s: np.ndarray) -> list[tuple]:
        level, bands = K.band_frames(s, rate)
        return [(i, i * K.BAND_HOP_S + K.BAND_FRAME_S / 2, float(x), b.tolist()) for i, (x, b) in enumerate(zip(level, bands))]

    return _kernel(pcm, "idx long, center_s double, rms double, vec array<double>", rows, by)


def novelties(pcm: DataFrame, rate: int, side: float, step: float, by: str = BY) -> DataFrame:
    """by, time_s, novelty: directed novelty at each step with `side` seconds on both sides."""
    n, hop = round(side * rate), round(step * rate)
    return _kernel(pcm, "time_s double, novelty double", lambda s: [(c / rate, K.directed_novelty(s[c - n : c], s[c : c + n], rate)) for c in range(n, len(s) - n + 1, hop)], by)


def novelty_at(pcm: DataFrame, candidates: DataFrame, rate: int, side: float, by: str = BY) -> DataFrame:
    """candidates(k, time_s: from the signal's start) with directed novelty; null where either side isn't whole. A stream's candidates go to its signal."""
    n = round(side * rate)
    on_workers()
    times = candidates.groupBy(by).agg(F.collect_list(F.struct("k", "time_s")).alias("times"))
    rows = pcm.join(times, by).select(by, "data", "times")
    key, k = dict(pcm.dtypes)[by], dict(candidates.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for stream, data, found in zip(*(c.to_pylist() for c in batch.columns)):
                s = K.from_pcm(data or b"")
                for t in found:
                    c = round(t["time_s"] * rate)
                    whole = c - n >= 0 and c + n <= len(s)
                    out.append((stream, t["k"], t["time_s"], K.directed_novelty(s[c - n : c], s[c : c + n], rate) if whole else None))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 4, types)], [by, "k", "time_s", "novelty"])

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(f"{by} {key}, k {k}, time_s double, novelty double")
    types = [f.type for f in to_arrow_schema(schema)]
    return rows.mapInArrow(run, schema)


def edge_evidence(features: DataFrame, horizons=(0.25, 0.5), by: str = BY) -> DataFrame:
    """by, idx, horizon_s, energy, spectral: change of mean RMS and Jensen-Shannon divergence of mean band shares between the horizon before each frame and from it on."""
    w = Window.partitionBy(by).orderBy("idx")
    bands = range(K.BANDS + 2)
    out = None
    for h in horizons:
        n = round(h / K.BAND_HOP_S)
        before, after = w.rangeBetween(-n, -1), w.rangeBetween(0, n - 1)
        mean = lambda side: F.array(*[F.avg(F.col("vec")[b]).over(side) for b in bands])
        x = features.select(by, "idx", F.lit(float(h)).alias("horizon_s"), F.avg("rms").over(before).alias("a"), F.avg("rms").over(after).alias("b"), mean(before).alias("p"), mean(after).alias("q")).where("a is not null and b is not null")
        energy = F.abs(F.col("a") - F.col("b")) / F.greatest(F.col("a") + F.col("b"), F.lit(K.TINY))
        x = x.select(by, "idx", "horizon_s", energy.alias("energy"), V.js_divergence(F.col("p"), F.col("q")).alias("spectral"))
        out = x if out is None else out.unionByName(x)
    return out
