"""SimHash near-dedup with a Gray-order hierarchical index.

Distinct fingerprints are dealt by blocks of bits: of radius + 1 blocks, two fingerprints within the radius agree in one
at least. Each bucket (a block and its value) is sorted by Gray rank, so that neighbours share most bits, and eight
neighbours make a node, eight nodes one of the next level. A node keeps the bits that all below it share, as a mask and a
pattern (held as the AND and the OR). Shared bits in which two nodes differ are differences of all pairs below; they only
grow on the way down, so a pair of nodes beyond the radius is dropped with all below. Nodes whose fingerprints are all
linked already are dropped too, which keeps a dense group from being met pair by pair.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, checkpoint, lookup, map_batches, per_text, spread
from .graph import components

SEED = 42
RADIUS = 3
FANOUT = 8
#: Pairs of nodes that are looked at together.
FRONTIER = 1 << 14
U64 = np.uint64
STEP = 1 << 16


def fingerprinter(shingle: int):
    """A function of a text: its 64-bit fingerprint, as an unsigned number."""
    import xxhash

    find, digest = re.compile(WORD.encode()).findall, xxhash.xxh64_intdigest

    def fingerprint(text: str) -> int:
        words = find(text.encode("utf-8", "surrogatepass").lower())
        if not words:
            return 0
        joined = b" ".join(words)
        width = min(shingle, len(words))
        at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1))).tolist()
        return majority(np.array([digest(joined[a : b - 1], SEED) for a, b in zip(at, at[width:])], U64))

    return fingerprint


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        ones += np.unpackbits(hashes[i : i + STEP].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(U64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep` and fp (the fingerprint's bits as a signed long) for each row. Texts without words have 0."""

    def factory():
        fingerprint = fingerprinter(shingle)
        return lambda t: (signed(fingerprint(t)),)

    return per_text(docs, "fp long", factory, keep, text)


def gray_rank(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U64(s))
    return x


class GrayForest:
    """The buckets of one partition: fps sorted by (bucket, Gray rank), with trees over each bucket."""

    def __init__(self, bucket: np.ndarray, fps: np.ndarray, shift: np.ndarray):
        turned = np.where(shift == 0, fps, (fps << shift) | (fps >> ((U64(64) - shift) & U64(63))))
        order = np.lexsort((gray_rank(turned), bucket))
        self.fps, bucket = fps[order], bucket[order]
        begins = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        sizes = np.diff(np.append(begins, len(bucket)))
        inside = np.arange(len(bucket)) - np.repeat(begins, sizes)
        self.starts, self.ands, self.ors, self.kids = [np.arange(len(bucket))], [self.fps], [self.fps], [None]
        width = 1
        while width < sizes.max():
            width *= FANOUT
            at = np.flatnonzero(inside % width == 0)
            below = np.searchsorted(self.starts[-1], at)
            self.kids.append(np.append(below, len(self.starts[-1])))
            self.starts.append(at)
            self.ands.append(np.bitwise_and.reduceat(self.ands[-1], below))
            self.ors.append(np.bitwise_or.reduceat(self.ors[-1], below))
        self.label = np.arange(len(bucket))
        self.bucket = bucket

    def link(self, a: np.ndarray, b: np.ndarray) -> bool:
        a, b = self.label[a], self.label[b]
        a, b = np.minimum(a, b), np.maximum(a, b)
        new = a < b
        if not new.any():
            return False
        parent = {}

        def root(x):
            while (y := parent.get(x, x)) != x:
                parent[x] = parent.get(y, y)
                x = y
            return x

        for x, y in np.unique(np.stack([a[new], b[new]], axis=1), axis=0).tolist():
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        to = np.arange(len(self.label))
        to[list(parent)] = [root(x) for x in list(parent)]
        self.label = to[self.label]
        self.one = [(np.minimum.reduceat(self.label, s), np.maximum.reduceat(self.label, s)) for s in self.starts]
        return True

    def run(self, radius: int) -> np.ndarray:
        """Labels of the fps: equal within a bucket if chains of links within the radius join them there."""
        self.one = [(s, np.append(s[1:], len(self.fps)) - 1) for s in self.starts]
        for step in (1, 2, 3):  # neighbours first: most of a dense group is one component before any pair of nodes is met
            near = np.flatnonzero((np.bitwise_count(self.fps[step:] ^ self.fps[:-step]) <= radius) & (self.bucket[step:] == self.bucket[:-step]))
            self.link(near, near + step)
        for level in range(1, len(self.starts)):
            kids = self.kids[level]
            count = np.diff(kids)
            for gap in range(1, FANOUT):  # pairs of siblings
                first = np.concatenate([kids[:-1][count > i + gap] + i for i in range(FANOUT - gap)])
                stack = [(level - 1, first[i : i + FRONTIER], first[i : i + FRONTIER] + gap) for i in range(0, len(first), FRONTIER)]
                while stack:
                    stack += self._down(*stack.pop(), radius)
        return self.label

    def _down(self, level: int, a: np.ndarray, b: np.ndarray, radius: int) -> list:
        low, high = self.one[level]
        known = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
        a, b = a[~known], b[~known]
        ands, ors = self.ands[level], self.ors[level]
        near = np.bitwise_count((ands[a] & ~ors[b]) | (ands[b] & ~ors[a])) <= radius
        a, b = a[near], b[near]
        if not len(a):
            return []
        if level == 0:
            self.link(a, b)
            return []
        kids = self.kids[level]
        na, nb = kids[a + 1] - kids[a], kids[b + 1] - kids[b]
        n = na * nb
        pair = np.repeat(np.arange(len(a)), n)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        a, b = kids[a][pair] + k // nb[pair], kids[b][pair] + k % nb[pair]
        return [(level - 1, a[i : i + FRONTIER], b[i : i + FRONTIER]) for i in range(0, len(a), FRONTIER)]


def reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the nodes 0..n-1 that each one reaches over edges a-b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label, new)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(fps: DataFrame, radius: int = RADIUS, agree: int = 1, paths: bool = False) -> DataFrame:
    """Edges u, v over distinct fps(fp): for each partition of buckets, each fingerprint and the least that it reaches there; with `paths`, and the one before it in Gray order of those that reach one another, so that none has many edges.

    The bits are cut into radius + agree blocks, of which `agree` at least are equal in two fingerprints within the radius:
    each choice of so many blocks deals all fingerprints by their values. More than one keeps buckets small at a wide radius.
    """
    blocks = radius + agree
    if not 1 <= blocks <= 64:
        raise ValueError("radius + agree must be 1 to 64")
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    choices = list(itertools.combinations(range(blocks), agree))
    masks = [sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in chosen) for chosen in choices]
    values = [F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks]
    dealt = fps.select("fp", F.posexplode(F.array(*values)).alias("block", "value")).select("block", "value", "fp")

    def index(batches):
        rows = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not rows:
            return
        block, value, fp = map(np.concatenate, zip(*rows))
        bucket = np.unique(np.stack([block.astype(np.int64), value], axis=1), axis=0, return_inverse=True)[1].ravel()
        # the last chosen block's bits, which are equal, come first
        shift = np.array([64 - cuts[chosen[-1] + 1] for chosen in choices], U64)[block]
        forest = GrayForest(bucket, fp.view(U64), shift)
        label = forest.run(radius)
        nodes, at = np.unique(forest.fps.view(np.int64), return_inverse=True)
        least = reachable(len(nodes), at, at[label])
        if paths:
            order = np.lexsort((gray_rank(nodes.view(U64)), least))
            same = least[order][1:] == least[order][:-1]
            yield {"u": nodes[order][1:][same], "v": nodes[order][:-1][same]}
            return
        hit = least != np.arange(len(nodes))
        yield {"u": nodes[hit], "v": nodes[least[hit]]}

    return map_batches(dealt.repartition(spread(dealt), "block", "value"), T._parse_datatype_string("u long, v long"), index)


def groups(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, agree: int = 1) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links) for each row of docs(doc_id, text).

    Texts without words (null, empty) have fingerprint 0, and link as any other. Repeated rows each stay. A null doc_id is
    never the smallest, unless all are null. An empty table gives no rows.
    """
    prints = checkpoint(fingerprints(docs.select("doc_id", "text"), shingle))
    nodes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    found = components(linked(nodes.select("fp"), radius, agree)).withColumnRenamed("node", "fp")
    nodes = checkpoint(nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    size = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    table = lookup(nodes.select("fp", "n", "component"), least, "component", "nodes", size[0])
    out = lookup(prints, table.select("fp", "component_id", "n"), "fp", "n", size[1])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Words of a shingle for near copies.
NEAR_SHINGLE = 5


def one_of_each(docs: DataFrame, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """One row of docs for each group of near copies, with the columns of docs: that with the smallest doc_id, and of those the least hash of its text.

    Fingerprints within RADIUS bits, by the Gray-order index, are candidates, as are texts with a common band of MinHashes
    (near.py says why); exact likeness decides. Rows that agree in doc_id and text are copies. Rows without a doc_id come
    last, so one of them stays only where all of its group are such. Null texts, empty ones and those without words are one
    group. An empty table gives no rows. Columns of any name pass through.
    """
    from . import near

    names = docs.columns
    own = docs.toDF(*(f"c{i}" for i in range(len(names))))
    doc_id, text = (f"c{names.index(n)}" for n in ("doc_id", "text"))
    keys = near.keys(F.col(doc_id), F.col(text))
    first = F.row_number().over(Window.partitionBy("id", "h").orderBy(F.xxhash64(*own.columns)))
    rows = own.select("*", *keys).withColumn("first", first).where("first = 1").drop("first")
    kept = near.least_of_each(own.select(*keys, F.col(text).alias("text")), shingle)
    return rows.join(kept, ["id", "h"], "left_semi").select(*own.columns).toDF(*names)


def brute_force(rows: list[tuple], shingle: int = 3, radius: int = RADIUS) -> list[tuple]:
    """What `groups` returns, from all pairs."""
    fingerprint = fingerprinter(shingle)
    fps = [fingerprint(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)), key=lambda k: rows[k][0])
                parent[b] = a
    return [(doc_id, f"{fp:016x}", rows[root(i)][0]) for i, ((doc_id, _), fp) in enumerate(zip(rows, fps))]
