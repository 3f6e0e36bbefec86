"""Toxicity by class-conditional Kneser-Ney models of words by their letters.

Each class has a model of its words: the next letter, or the word's end, after the letters before it. Counts are of texts
that hold a word, so that repeats within a text add nothing. The ordinary model is interpolated Kneser-Ney. The toxic one
is too, but what it lacks comes from counts that both classes share, by `strength` texts at each context; so an expression
that toxic texts hold too rarely to tell is as likely in either class, and one that was never met is judged by its letters.
Most words of a toxic text are ordinary ones: its likelihood is a mixture that takes a word from the toxic model with
chance `share`. A text's ratio is that of its distinct words, normalised by their number, and a logistic curve, fitted on
labelled texts that the models haven't seen, maps it to 0..1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import BASES, U64, mix, word_values, words_of
from .common import checkpoint, map_batches, slices, utf8

#: Labelled rows of each class that a fit reads at most, by a hash of doc_id; of these one in FOLDS only fits the curve.
FIT_ROWS = 3000
FOLDS = 4
DISCOUNT = 0.75
STRENGTH = 20.0
SHARE = 0.001
#: Distinct words that a text's length is taken to have besides its own, so that very short texts say little.
SPARE = 20
THRESHOLD = 0.7
#: Bytes of a word that the models look at; the end of a shorter word is a letter of its own. Longer words are cut into pieces that are words themselves.
LETTERS = 16
ALPHABET = 256
#: Words are runs of ASCII letters and digits and of all bytes beyond ASCII; A-Z are lower-cased.
BLANK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
END = 0x20


def _cuts() -> np.ndarray:
    """Whether a long word is cut behind two bytes: after half of the characters beyond ASCII, a quarter of the others."""
    pair = np.arange(1 << 16)
    return mix(pair.astype(U64) + U64(BASES[1])) & np.where(pair & 0x80, U64(1), U64(3)) == 0


CUTS = _cuts()


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as words_of gives them, those of more than LETTERS bytes in pieces that cover them: cut where the two bytes before say so, so that a passage is cut alike wherever it stands, and where a piece would be longer."""
    long = np.flatnonzero(ends - starts > LETTERS)
    if not len(long):
        return starts, ends, first
    at = np.flatnonzero(CUTS[data[:-2].astype(np.uint16) << 8 | data[1:-1]] & (data[2:] & 0xC0 != 0x80)) + 2
    own = long[np.maximum(np.searchsorted(starts[long], at, side="right") - 1, 0)]
    at = at[(at >= starts[own] + 2) & (at < ends[own])]
    begins = np.sort(np.concatenate((starts, at)))
    word = np.searchsorted(starts, begins, side="right") - 1
    stops = np.minimum(np.append(begins[1:], ends[-1]), ends[word])
    n = -(-(stops - begins) // LETTERS)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begins, stops, word = np.repeat(begins, n) + nth * LETTERS, np.repeat(stops, n), np.repeat(word, n)
    return begins, np.minimum(begins + LETTERS, stops), np.searchsorted(word, first)


def distinct_words(data: np.ndarray, offsets: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of the distinct words of all rows (LETTERS + 1 columns, 0 after the end) and their lengths with the end; and of each row and word that it holds, the row and the word's number. `whole`: of long words all pieces; else their first letters."""
    data = LOWER[data]
    starts, ends, first = words_of(data, offsets, BLANK)
    if whole:
        starts, ends, first = pieces(data, starts, ends, first)
    _, sample, word = np.unique(word_values(data, starts, ends, BASES[0]), return_index=True, return_inverse=True)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    held = np.unique(row * max(1, len(sample)) + word.ravel())
    starts, size = starts[sample], np.minimum(ends[sample] - starts[sample], LETTERS + 1)
    place = np.arange(LETTERS + 1)
    inside = place < size[:, None]
    letters = np.where(inside, data[np.where(inside, starts[:, None] + place, 0)] if len(data) else 0, 0).astype(np.uint8)
    short = np.flatnonzero(size <= LETTERS)
    letters[short, size[short]] = END
    return letters, np.minimum(size + 1, LETTERS + 1), held // max(1, len(sample)), held % max(1, len(sample))


def grown(h: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Hashes of prefixes that go on by a letter."""
    return mix(h * U64(BASES[0]) + letter.astype(U64) + U64(BASES[1]))


@dataclass
class Model:
    """known[i]: sorted hashes of prefixes of i + 1 letters; ratio: each one's log-likelihood ratio; unmet: what a letter that was never met after it adds."""

    known: list[np.ndarray]
    ratio: list[np.ndarray]
    unmet: list[np.ndarray]
    start: float = 0.0
    share: float = SHARE
    slope: float = 1.0
    shift: float = 0.0

    def words(self, letters: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of each word, by its longest known prefix."""
        value = np.full(len(letters), self.start)
        h, on = np.zeros(len(letters), U64), np.arange(len(letters))
        for i, (known, ratio, unmet) in enumerate(zip(self.known, self.ratio, self.unmet)):
            on = on[size[on] > i]
            h[on] = grown(h[on], letters[on, i])
            at = np.minimum(np.searchsorted(known, h[on]), len(known) - 1)
            hit = known[at] == h[on]
            on, at = on[hit], at[hit]
            value[on] = ratio[at] + np.where(size[on] > i + 1, unmet[at], 0.0)
        return value

    def ratios(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The ratio of each row's mixture to the ordinary model, by distinct words; 0 for rows without words."""
        letters, size, row, word = distinct_words(data, offsets, True)
        n = len(offsets) - 1
        if not len(letters) or not self.known:
            return np.zeros(n)
        value = np.log1p(self.share * np.expm1(self.words(letters, size)))
        return np.bincount(row, value[word], n) / (np.bincount(row, minlength=n) + SPARE)

    def scores(self, ratios: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * scale(ratios) + self.shift, -50, 50)))


def scale(ratios: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(ratios, 0) + SHARE)


def learn(letters: np.ndarray, size: np.ndarray, counts: np.ndarray, strength: float = STRENGTH, share: float = SHARE) -> Model:
    """A model from distinct words, sorted by their letters, and how many ordinary and toxic texts hold each (two columns)."""
    model = Model([], [], [], share=share)
    if not len(letters):
        return model
    differ = letters[1:] != letters[:-1]
    common = np.concatenate(([-1], np.where(differ.any(axis=1), differ.argmax(axis=1), letters.shape[1])))
    h = np.zeros(len(letters), U64)
    # the root is the one context of no letters
    above, n, total = np.zeros(len(letters), np.int64), counts.sum(axis=0)[None, :].astype(float), np.zeros(1)
    for depth in range(1, letters.shape[1] + 1):
        rows = np.flatnonzero(size >= depth)
        if not len(rows):
            break
        fresh = common[rows] < depth
        # of rows that are left out none begins a node, as a word that ends holds a letter of its own
        fresh |= np.concatenate(([True], above[rows][1:] != above[rows][:-1]))
        node, first = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        own = np.add.reduceat(counts[rows], first).astype(float)
        parent = above[rows][first]
        kinds = np.stack([np.bincount(parent, own[:, c] > 0, len(n)) for c in (0, 1)], axis=1)
        both, kinds_both = n.sum(axis=1), np.bincount(parent, minlength=len(n)).astype(float)
        floor = DISCOUNT * kinds_both / ALPHABET / np.maximum(both, 1)
        shared = np.maximum(own.sum(axis=1) - DISCOUNT, 0) / both[parent] + floor[parent]
        ordinary = np.where(n[parent, 0] > 0, (np.maximum(own[:, 0] - DISCOUNT, 0) + DISCOUNT * kinds[parent, 0] / ALPHABET) / np.maximum(n[parent, 0], 1), shared)
        loose = (DISCOUNT * kinds[:, 1] + strength) / (n[:, 1] + strength)
        toxic = np.maximum(own[:, 1] - DISCOUNT, 0) / (n[parent, 1] + strength) + loose[parent] * shared
        with np.errstate(divide="ignore", invalid="ignore"):
            unmet = np.log(loose * floor / np.where(n[:, 0] > 0, DISCOUNT * kinds[:, 0] / ALPHABET / np.maximum(n[:, 0], 1), floor))
        unmet = np.where(kinds_both > 0, unmet, 0.0)
        if depth > 1:
            order = np.argsort(keys)
            model.known.append(keys[order])
            model.ratio.append(total[order])
            model.unmet.append(unmet[order])
        else:
            model.start = float(unmet[0])
        h[rows] = grown(h[rows], letters[rows, depth - 1])
        keys, total, n = h[rows][first], total[parent] + np.log(toxic) - np.log(ordinary), own
        above[rows] = node
    order = np.argsort(keys)
    model.known.append(keys[order])
    model.ratio.append(total[order])
    model.unmet.append(np.zeros(len(order)))
    return model


def curve(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method, classes weighing as they occur, with a weak ridge."""
    scale = max(1e-9, float(np.abs(x).max(initial=0)))
    a = np.stack([x / scale, np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        g = a.T @ (p - y) + 1e-2 * beta
        hessian = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        beta -= np.linalg.solve(hessian, g)
    return float(beta[0] / scale), float(beta[1])


def word_counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of labelled(text, toxic): distinct words' letters in order, their lengths, and how many ordinary and toxic texts hold each. Words are counted by Spark; each reaches the driver once."""
    rows = labelled.select("text", F.col("toxic").cast("int").alias("toxic"))

    def run(batches) -> Iterator[dict]:
        for batch in batches:
            for piece in slices(batch):
                letters, size, row, word = distinct_words(*utf8(piece.column(0)), True)
                toxic = piece.column(1).to_numpy()[row]
                n = np.stack([np.bincount(word[toxic == c], minlength=len(letters)) for c in (0, 1)])
                raw = letters.tobytes()
                wide = LETTERS + 1
                yield {"word": [raw[i * wide : i * wide + k] for i, k in enumerate(size.tolist())], "ordinary": n[0], "toxic": n[1]}

    words = map_batches(rows, T._parse_datatype_string("word binary, ordinary long, toxic long"), run)
    table = words.groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")).toArrow().combine_chunks()
    table = table.sort_by("word")
    found = table["word"].to_pylist()
    letters = np.array(found, f"S{LETTERS + 1}") if found else np.zeros(0, f"S{LETTERS + 1}")
    letters = np.frombuffer(letters.tobytes(), np.uint8).reshape(-1, LETTERS + 1)
    return letters, np.array([len(w) for w in found], np.int64), np.stack([table["ordinary"].to_numpy(), table["toxic"].to_numpy()], axis=1)


def fit(labelled: DataFrame, strength: float = STRENGTH, share: float = SHARE) -> Model:
    """A model of labelled(doc_id, text, toxic), whole texts. Without rows of both classes, all scores are 0."""
    rows = labelled.select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"), (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)) == 0).alias("unseen")).where("toxic is not null")
    rows = checkpoint(rows)  # of at most 2 * FIT_ROWS
    classes = {(r.toxic, r.unseen) for r in rows.select("toxic", "unseen").distinct().collect()}
    if len({c for c, _ in classes}) < 2:
        return Model([], [], [], 0.0, share, 0.0, -50.0)
    apart = classes >= {(0, False), (1, False), (0, True), (1, True)}
    model = learn(*word_counts(rows.where("not unseen") if apart else rows), strength, share)
    some = ratios(rows.where("unseen") if apart else rows, model, ("toxic",)).collect()
    model.slope, model.shift = curve(scale(np.array([r.ratio for r in some])), np.array([r.toxic for r in some]))
    return model


def sample(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """doc_id, text, toxic of at most `most` labelled documents of each class, by a hash of doc_id. labels(doc_id, toxic)."""
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), "doc_id")
    picked = labels.where("toxic = 1").orderBy(*order).limit(most).unionByName(labels.where("toxic = 0").orderBy(*order).limit(most))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # 2 * most rows of two numbers


def ratios(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and ratio: each row's length-normalised log-likelihood ratio."""
    rows = docs.select(*keep, docs["text"].alias("__text"))
    schema = T.StructType([*rows.schema[:-1], T.StructField("ratio", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of the words of 2 * FIT_ROWS texts, whatever the input's size

    def run(batches) -> Iterator[dict]:
        model = shared.value
        for batch in batches:
            for piece in slices(batch, "__text"):
                yield {**{k: piece.column(i) for i, k in enumerate(keep)}, "ratio": pa.array(model.ratios(*utf8(piece.column(len(keep)))))}

    return map_batches(rows, schema, run)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and score (0 to 1, double) for each row of docs. Null and empty texts score as a text that speaks for neither class."""
    z = F.log(F.greatest(F.col("ratio"), F.lit(0.0)) + SHARE) * model.slope + model.shift
    return ratios(docs, model, keep).select(*keep, (1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), z))))).alias("score"))


def held_out(doc_id) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text); labels of held-out rows are never read.

    Null and empty texts have no words, and score as texts that speak for neither class; texts of any length are read whole.
    Rows that repeat each get the same score; a null doc_id isn't held out and has no label; of labels that share a doc_id
    the greatest counts. An empty table gives no rows; without labels of both classes all scores are 0. Other columns are
    not read.
    """
    model = fit(sample(docs, labels.where(~held_out(F.col("doc_id")))))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
