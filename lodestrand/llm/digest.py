"""Document fingerprints: quartile bucket digests.

Six byte triplets of every five-byte window are hashed into buckets. A digest holds each bucket's quartile among all
bucket counts (two bits) and the length on a logarithmic scale, so that equal shares of triplets give equal digits
whatever the text's size. The difference score adds the distances of digits, with more for opposite quartiles, and the
distance of lengths; it is bounded, and likeness maps it to 0..1.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, per_text, slices, spread

BUCKETS = 256
#: Places in the five-byte window that make a triplet, and the odd multiplier of each one's hash. Fixed values.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D)
WINDOW = 5
#: Bytes whose triplets are counted at once.
STEP = 1 << 18
#: Score of digests of unrelated texts: the mean of the digit distances 0, 1, 2, 6 (opposite quartiles) over independent quartiles.
FAR = BUCKETS * (6 * 1 + 4 * 2 + 2 * 6) / 16
#: Added for each step of the length digit, up to a bound.
LENGTH_COST, LENGTH_MOST = 4, 64


def bucket_counts(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for start in range(0, max(0, len(a) - WINDOW + 1), STEP):
        part = a[start : start + STEP + WINDOW - 1].astype(np.uint32)
        n = len(part) - WINDOW + 1
        out = np.empty((len(TRIPLETS), n), np.uint8)
        first = part[:n]
        for k, ((_, j, m), factor) in enumerate(zip(TRIPLETS, FACTORS)):
            v = (part[j : j + n] << np.uint32(8)) | first
            v |= part[m : m + n] << np.uint32(16)
            v *= np.uint32(factor)
            v ^= v >> np.uint32(15)
            v *= np.uint32(factor)
            v >>= np.uint32(24)
            out[k] = v
        total += np.bincount(out.ravel(), minlength=BUCKETS)
    return total


def fingerprint(data: bytes) -> str:
    """Two hex digits of length, then two bits for each bucket. Texts under five bytes have no triplets: all digits are 0, and the length digits take their bytes' hash."""
    length = min(254, round(math.log(len(data), 1.2))) + 1 if data else 0
    if len(data) < WINDOW:
        return f"{length:02x}" + hashlib.sha256(data).hexdigest()[:2] + "0" * (BUCKETS // 2 - 2) if data else "00" + "0" * (BUCKETS // 2)
    counts = bucket_counts(data)
    q1, q2, q3 = np.partition(counts, (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1))[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    digits = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = digits[0::4] << 6 | digits[1::4] << 4 | digits[2::4] << 2 | digits[3::4]
    return f"{length:02x}" + packed.astype(np.uint8).tobytes().hex()


def _digits(fp: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(fp[2:]), np.uint8)
    return np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3]).astype(np.int8)


def difference(a: str, b: str) -> int:
    """0 for equal digests; at most 6 * BUCKETS + LENGTH_MOST."""
    steps = np.abs(_digits(a) - _digits(b))
    return int(steps.sum()) + 3 * int((steps == 3).sum()) + min(LENGTH_MOST, LENGTH_COST * abs(int(a[:2], 16) - int(b[:2], 16)))


def likeness(a: str, b: str) -> float:
    return 1.0 if a == b else max(0.0, 1.0 - difference(a, b) / FAR)


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and `fingerprint` for each row; a null text counts as empty."""
    return per_text(docs, "fingerprint string", lambda: lambda t: (fingerprint(t.encode("utf-8", "surrogatepass")),), keep, text)


def _splitters(docs: DataFrame, parts: int) -> np.ndarray:
    points = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(10_000, 10 * parts))).first()[0] if parts > 1 else None
    return np.unique(np.array(points or [], np.int64))


def chained(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs(doc_id, text).

    Order: descending doc_id, null last; rows that share a doc_id by text; after the last the first. The edited text is
    the text with its last floor(n_chars/2) code points replaced by as many from the next text's head. A single row is its
    own next. An empty table gives no rows. Null texts are empty.

    Rows are dealt once, into ranges of doc_id between sampled splitters (as many as partitions). The first document of a
    range is also sent to the range before it, so a range needs nothing of another. A range is read as a sorted stream.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = parts or spread(docs)
    splitters = _splitters(docs, parts)

    def range_of(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
        """0 is met first: the greatest ids; null ids are met last."""
        return np.where(null, len(splitters) + 1, len(splitters) - np.searchsorted(splitters, ids, side="right")).astype(np.int32)

    def ids_of(batch):
        column = batch.column(0)
        return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_null().to_numpy(zero_copy_only=False)

    def heads(batches):
        best: dict[int, int | None] = {}
        for batch in batches:
            ids, null = ids_of(batch)
            at = range_of(ids, null)
            for r in np.unique(at):
                most = None if r > len(splitters) else int(ids[at == r].max())
                best[int(r)] = most if best.get(int(r)) is None else max(most, best[int(r)])
        yield {"range": list(best), "head": list(best.values())}

    # one row a range and task, reduced before it reaches the driver: as many rows as ranges
    firsts = dict(map_batches(docs.select("doc_id"), T._parse_datatype_string("range int, head long"), heads).groupBy("range").agg(F.max("head")).collect())
    filled = sorted(firsts)
    before = {r: filled[i - 1] for i, r in enumerate(filled)}  # the first range's head goes to the last
    dealt = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("extra", T.BooleanType()), *docs.schema])

    def deal(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids, null = ids_of(batch)
            at = range_of(ids, null)
            yield {"range": at, "extra": np.zeros(len(at), bool), "doc_id": batch.column(0), "text": batch.column(1)}
            is_head = np.zeros(len(at), bool)
            for r in np.unique(at):
                is_head |= (at == r) & (null if firsts[int(r)] is None else ids == firsts[int(r)])
            if is_head.any():
                more = batch.filter(pa.array(is_head))
                yield {"range": np.array([before[int(r)] for r in at[is_head]], np.int32), "extra": np.ones(more.num_rows, bool), "doc_id": more.column(0), "text": more.column(1)}

    ordered = map_batches(docs, dealt, deal).repartitionById(parts, "range").sortWithinPartitions("range", "extra", F.col("doc_id").desc_nulls_last(), "text")
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")])

    def judge(batches):
        held = None  # range, doc_id, text, bytes, fingerprint
        done = None  # the range whose extra row was met
        for batch in batches:
            for piece in slices(batch):
                rows = []
                for r, extra, doc_id, text in zip(*(c.to_pylist() for c in piece.columns)):
                    if extra and done == r:
                        continue
                    data = text.encode("utf-8", "surrogatepass")
                    own = fingerprint(data)
                    if held is not None and held[0] == r:
                        _, last_id, last, last_fp = held
                        half = len(last) // 2
                        edited = (last[: len(last) - half] + text[:half]).encode("utf-8", "surrogatepass")
                        edited_fp = fingerprint(edited)
                        rows.append((last_id, len(last), hashlib.sha256(edited).hexdigest(), last_fp, edited_fp, likeness(last_fp, edited_fp), likeness(last_fp, own)))
                    held = None if extra else (r, doc_id, text, own)
                    done = r if extra else done
                yield dict(zip(schema.names, zip(*rows) if rows else [[] for _ in schema.names]))

    return map_batches(ordered, schema, judge)
