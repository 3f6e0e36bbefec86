"""Quality rules: counts that any text must pass, then compression bands.

A band is a range of zstandard ratios (compressed by raw bytes) with limits of its own for each length. A text below its
band is repetitive, one above it incompressible. The whole text has a band by its length; fixed chunks share one, and a
text is rejected if over half of its chunks lie outside.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, checkpoint, per_text

CHUNK_BYTES = 4096
LEVEL = 3
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
#: The share of good texts that a fit of the bands may put outside a limit.
FIT_TAIL = 0.004
FIT_MARGIN = 0.02
FIT_LEAST = 40


@dataclass(frozen=True)
class Bands:
    """limits[i] holds for texts of fewer than below[i] bytes, the last for longer ones; chunk for whole chunks."""

    below: tuple[int, ...] = (256, 512, 1024, 2048, 4096, 8192, 16384, 32768)
    limits: tuple[tuple[float, float], ...] = ((0.35, 1.5), (0.32, 0.90), (0.30, 0.80), (0.28, 0.75), (0.26, 0.70), (0.25, 0.68), (0.24, 0.66), (0.23, 0.65), (0.22, 0.65))
    chunk: tuple[float, float] = (0.25, 0.70)

    def at(self, n_bytes: int) -> tuple[float, float]:
        return self.limits[bisect.bisect_right(self.below, n_bytes)]


def compression(chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL):
    """A function of bytes: ratio of the whole, and of its chunks. The last chunk ends with the text, and so may overlap the one before; a text shorter than a chunk is one."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=level)

    def ratios(data: bytes) -> tuple[float, list[float]]:
        if not data:
            return 0.0, []
        whole = len(packer.compress(data)) / len(data)
        if len(data) <= chunk_bytes:
            return whole, [whole]
        view = memoryview(data)
        starts = [*range(0, len(data) - chunk_bytes, chunk_bytes), len(data) - chunk_bytes]
        return whole, [len(packer.compress(view[i : i + chunk_bytes])) / chunk_bytes for i in starts]

    return ratios


def counts(text: str, find_words=re.compile(WORD).findall) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, as the contract defines them."""
    words = find_words(text)
    n_symbols = sum(map(text.count, SYMBOLS))
    n_dup_lines = 0
    if "\n" in text:
        lines = text.split("\n")
        if len(set(lines)) < len(lines):
            n_dup_lines = sum(n - 1 for line, n in Counter(lines).items() if n > 1 and find_words(line))
    n_repeat = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        found = Counter(windows)
        end = 0
        for i, window in enumerate(windows):
            if found[window] > 1:
                n_repeat += i + 3 - max(i, end)
                end = i + 3
    return len(words), sum(map(len, words)), n_symbols, n_dup_lines, n_repeat


def measure(docs: DataFrame, bands: Bands = Bands(), keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep`, the counts, base_failed, ratio, n_chunks, n_outside (chunks outside the band) and kept for each row.

    A null or empty text has no words and so fails; a text of any length is read whole; repeated rows stay, each with the
    same verdict; an empty table gives no rows. Columns besides `keep` and the text are not read.
    """

    def factory():
        ratios = compression()
        low, high = bands.chunk

        def judge(t):
            n_words, *rest = counts(t)
            n_repeat = rest[-1]
            failed = n_words < MIN_WORDS or 100 * n_repeat > 50 * n_words
            data = t.encode("utf-8", "surrogatepass")
            ratio, chunks = ratios(data)
            outside = sum(not low <= x <= high for x in chunks)
            least, most = bands.at(len(data))
            return n_words, *rest, failed, not failed and least <= ratio <= most and 2 * outside <= len(chunks), ratio, len(chunks), outside

        return judge

    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_outside long"
    return per_text(docs, fields, factory, keep, text)


def kept(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    names = tuple(docs.columns)
    return measure(docs.toDF(*(f"c{i}" for i in range(len(names)))), bands, tuple(f"c{i}" for i in range(len(names))), f"c{names.index('text')}").where("kept").select(*(f"c{i}" for i in range(len(names)))).toDF(*names)


def quantiles(values: DataFrame, shares: tuple[float, ...], steps: int = 10_000) -> dict[int, tuple[int, list[float]]]:
    """Of values(place int, ratio), for each place how many there are, and the exact quantiles (linear between neighbours).

    Counts of ratios by steps of 1 / `steps` tell in which steps the rows in question stand, and only these steps' ratios
    reach the driver, each distinct one once.
    """
    stepped = values.withColumn("step", F.floor(F.col("ratio") * steps))
    counted: dict[int, list] = {}
    for r in stepped.groupBy("place", "step").count().orderBy("place", "step").collect():
        counted.setdefault(r.place, []).append((r.step, r["count"]))
    wanted, ranks = set(), {}
    for place, found in counted.items():
        ends = np.cumsum([n for _, n in found])
        at = [(int(ends[-1]) - 1) * share for share in shares]
        ranks[place] = (found, ends, at)
        wanted |= {(place, found[int(np.searchsorted(ends, k, side="right"))][0]) for x in at for k in (math.floor(x), math.ceil(x))}
    if not wanted:
        return {}
    few = values.sparkSession.createDataFrame(sorted(wanted), "place int, step long")
    exact: dict[tuple, list] = {}
    for r in stepped.join(F.broadcast(few), ["place", "step"]).groupBy("place", "step", "ratio").count().orderBy("place", "step", "ratio").collect():
        exact.setdefault((r.place, r.step), []).append((r.ratio, r["count"]))
    out = {}
    for place, (found, ends, at) in ranks.items():
        def ranked(k: int) -> float:
            i = int(np.searchsorted(ends, k, side="right"))
            ratios, n = zip(*exact[place, found[i][0]])
            return ratios[int(np.searchsorted(np.cumsum(n), k - (int(ends[i - 1]) if i else 0), side="right"))]

        out[place] = (int(ends[-1]), [ranked(math.floor(x)) + (ranked(math.ceil(x)) - ranked(math.floor(x))) * (x - math.floor(x)) for x in at])
    return out


def fit(good: DataFrame, ids: DataFrame | None = None, tail: float = FIT_TAIL, margin: float = FIT_MARGIN) -> Bands:
    """Bands around the ratios of all of `good`(doc_id, text), texts known to be good; with `ids`(doc_id), of those whose doc_id is there, which moves no text, as they are told apart by then.

    A length with fewer than FIT_LEAST texts keeps the default limits. Limits stand `margin` beyond the quantiles `tail` and 1 - tail.
    """
    default = Bands()
    found = measure(good.where(F.col("text").isNotNull()).select("doc_id", "text", F.octet_length("text").alias("n_bytes")), keep=("doc_id", "n_bytes")).where(~F.col("base_failed"))
    if ids is not None:
        found = found.select("doc_id", "n_bytes", "ratio").join(ids, "doc_id", "left_semi")
    place = sum((F.col("n_bytes") >= n).cast("int") for n in default.below)
    values = checkpoint(found.select(place.alias("place"), "ratio"))  # two numbers a row
    own = quantiles(values, (tail, 1 - tail))
    limits = []
    for i, (low, high) in enumerate(default.limits):
        n, ends = own.get(i, (0, ()))
        limits.append((low, high) if n < FIT_LEAST else (max(low, ends[0] - margin), min(high, max(0.7, ends[1] + 5 * margin))))
    return Bands(limits=tuple(limits))
