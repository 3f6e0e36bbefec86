"""Near copies by exact Jaccard likeness: SimHash links and MinHash bands give candidates, sets of word shingles decide.

SimHash alone can't: sets of likeness J differ in a bit with chance acos(2J / (1 + J)) / pi, 0.15 at 0.8, so of 64 bits about ten
differ, and a radius that holds them holds strangers too. Its links (within RADIUS bits, by the Gray-order index) join dense
groups at once; MinHash bands find the rest.
Texts of one likeness J share a band with chance J^ROWS, and one of BANDS with 1 - (1 - J^ROWS)^BANDS: 0.99993 at 0.8. Distinct
sets are nodes. A link is kept only if its two sets are like enough, so a pair without a common band is all that can be missed.

Candidates are met in two rounds, so that a dense group isn't met pair by pair. The first takes all pairs of small buckets, and
of a large one neighbours in the order of the next band, in a few bands. The second meets each pair of a large bucket that the
first round's links don't join: all but the bucket's largest component, in blocks, against the whole bucket, in blocks. No bucket
is held by one task.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, checkpoint, lookup, map_batches, per_text, split_join, spread
from .graph import components
from .simhash import linked, majority, signed

SEED = 42
ROWS, BANDS = 5, 24
#: The least likeness of near copies, as a fraction.
LIKE = (4, 5)
#: Buckets of up to so many nodes are met pair by pair at once; larger ones by neighbours in so many bands.
SMALL, FIRST_BANDS = 4, 4
#: Sets in a block of the second round.
BLOCK = 256
U64 = np.uint64
STEP = 1 << 12
#: Odd factors of the ROWS * BANDS hashes.
ODD = (np.random.default_rng(SEED).integers(0, 1 << 63, (2, ROWS * BANDS, 1), dtype=U64) << U64(1)) | U64(1)


def shingler(shingle: int):
    """A function of a text: the sorted distinct hashes of its shingles of lower-case words (of all its words if they are fewer)."""
    import xxhash

    find, digest = re.compile(WORD.encode()).findall, xxhash.xxh64_intdigest

    def shingles(text: str) -> np.ndarray:
        words = find(text.encode("utf-8", "surrogatepass").lower())
        if not words:
            return np.zeros(0, U64)
        joined = b" ".join(words)
        width = min(shingle, len(words))
        at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1))).tolist()
        return np.unique(np.array([digest(joined[a : b - 1], SEED) for a, b in zip(at, at[width:])], U64))

    return shingles


def node_of(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.array(xxhash.xxh64_intdigest(hashes.tobytes(), SEED), U64).view(np.int64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """BANDS hashes of ROWS least values each; none for an empty set."""
    import xxhash

    if not len(hashes):
        return []
    least = np.full(ROWS * BANDS, ~U64(0))
    for i in range(0, len(hashes), STEP):
        x = hashes[i : i + STEP] * ODD[0]
        x ^= x >> U64(32)
        x *= ODD[1]
        x ^= x >> U64(29)
        least = np.minimum(least, x.min(axis=1))
    digests = [xxhash.xxh64_intdigest(row.tobytes(), SEED + i) for i, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(digests, U64).view(np.int64).tolist()


NULL_ID = -(1 << 63)


def keys(doc_id, text) -> tuple:
    """What names a row: its doc_id (the least long for none) and a hash of its text."""
    return F.coalesce(doc_id.cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h")


def sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """id, h, node (of its set of shingles), size (of the set), fp (its SimHash) and band keys for each of rows(id, h, text)."""

    def factory():
        shingles = shingler(shingle)

        def sketch(text):
            hashes = shingles(text)
            return node_of(hashes), len(hashes), signed(majority(hashes)), band_keys(hashes)

        return sketch

    return per_text(rows, "node long, size int, fp long, bands array<long>", factory, ("id", "h"))


def alike(a: int, b: int) -> bool:
    """Whether sets of a and b elements can be like enough."""
    return LIKE[1] * min(a, b) >= LIKE[0] * max(a, b)


def _columns(batches) -> list[np.ndarray] | None:
    rows = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    return list(map(np.concatenate, zip(*rows))) if rows else None


def _met(nodes: DataFrame) -> DataFrame:
    """Of nodes(node, size, bands): pairs a, b to compare first (size -1), and the rows of large buckets: a (bucket), b (node), size.

    Buckets are sorted by range, which also divides large ones; one that touches a partition's end may go on in the next, and
    counts as large.
    """
    following = F.element_at("bands", F.pmod(F.col("band") + 1, F.lit(BANDS)) + 1)
    dealt = nodes.select("node", "size", "bands", F.posexplode("bands").alias("band", "key")).select("band", "key", "node", "size", following.alias("following"))

    def meet(batches):
        if (rows := _columns(batches)) is None:
            return
        band, key, node, size, following = rows
        order = np.lexsort((node, following, key, band))
        band, key, node, size = band[order], key[order], node[order], size[order]
        begins = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (band[1:] != band[:-1]))))
        counts = np.diff(np.append(begins, len(key)))
        large = counts > SMALL
        large[[0, -1]] = True
        count, inside, large = np.repeat(counts, counts), np.arange(len(key)) - np.repeat(begins, counts), np.repeat(large, counts)
        a, b = [], []
        for gap in range(1, SMALL):
            wanted = ~large | ((gap == 1) & (band < FIRST_BANDS))
            at = np.flatnonzero((inside + gap < count) & wanted)
            at = at[LIKE[1] * np.minimum(size[at], size[at + gap]).astype(np.int64) >= LIKE[0] * np.maximum(size[at], size[at + gap]).astype(np.int64)]
            a.append(np.minimum(node[at], node[at + gap]))
            b.append(np.maximum(node[at], node[at + gap]))
        pairs = sum(map(len, a))
        yield {
            "a": np.concatenate([*a, key[large] + band[large]]),
            "b": np.concatenate([*b, node[large]]),
            "size": np.concatenate([np.full(pairs, -1, np.int32), size[large].astype(np.int32)]),
        }

    ordered = dealt.repartitionByRange(spread(dealt), "band", "key", "following", "node")
    return map_batches(ordered, T._parse_datatype_string("a long, b long, size int"), meet)


def _blocks(large: DataFrame) -> DataFrame:
    """What the second round compares: rows of large(bucket, node, component) as members of (team, node, component, lead).

    Nodes of a bucket's largest component needn't be met with one another. The others lead, in blocks, and meet all, in blocks;
    a team is one block of each, so no task holds a bucket.
    """
    sizes = large.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
    stats = sizes.groupBy("bucket").agg(F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("top")).where("n > top.c")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    stats = checkpoint(stats.select("bucket", "n", F.col("top.component").alias("top"), blocks(F.col("n")).alias("all"), blocks(F.col("n") - F.col("top.c")).alias("leads")))
    total = stats.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = lookup(large.select("bucket", "node", "component"), stats, "bucket", "n", total)
    place = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.select("bucket", every("leads").alias("i"), place(0, "all").alias("j"), "node", "component", F.lit(False).alias("lead"))
    leads = rows.where("component <> top").select("bucket", place(1, "leads").alias("i"), every("all").alias("j"), "node", "component", F.lit(True).alias("lead"))
    return members.unionByName(leads).select(F.xxhash64("bucket", "i", "j").alias("team"), "node", "component", "lead")


def links_of(nodes: list[int], components: list[int], leads: list[bool], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join components: of pairs of a leading node and another, those that are like enough."""
    label = np.unique(np.array(components, np.int64), return_inverse=True)[1].ravel()
    sizes = np.array([len(s) for s in sets])
    starts, flat, found = np.cumsum(sizes) - sizes, np.concatenate(sets), []
    for i in np.flatnonzero(leads):
        if (label == label[i]).all():
            continue
        mine = sets[i]
        at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        common = np.add.reduceat((mine[at] == flat).astype(np.int64), starts)
        for j in np.flatnonzero(LIKE[1] * common >= LIKE[0] * (sizes + len(mine) - common)):
            if label[j] != label[i]:
                found.append((nodes[i], nodes[j]))
                label[label == label[j]] = label[i]
    return found


def _verified(members: DataFrame) -> DataFrame:
    """Links u, v among members(team, node, component, lead, hashes)."""
    held = members.select("team", "node", "component", "lead", "hashes")
    held = held.repartition(spread(held), "team").sortWithinPartitions("team")

    def check(batches):
        team, rows = None, {}

        def links():
            if len(rows) < 2:
                return []
            nodes = list(rows)
            return links_of(nodes, *zip(*((c, lead, s) for c, lead, s in rows.values())))

        for batch in batches:
            found = []
            for t, node, component, lead, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                if t != team:
                    found += links()
                    team, rows = t, {}
                rows[node] = (component, lead or (node in rows and rows[node][1]), np.frombuffer(hashes, U64))
            if found:
                yield {"u": [u for u, _ in found], "v": [v for _, v in found]}
        if found := links():
            yield {"u": [u for u, _ in found], "v": [v for _, v in found]}

    return map_batches(held, T._parse_datatype_string("u long, v long"), check)


def _sets(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node, hashes of wanted(node, id, h)."""

    def factory():
        shingles = shingler(shingle)
        return lambda text: (shingles(text).tobytes(),)

    return per_text(rows.join(wanted, ["id", "h"]).select("node", "text"), "hashes binary", factory, ("node",))


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs a, b of nodes(node, fp) whose fingerprints are neighbours among those that links within RADIUS bits join. One node stands for a fingerprint."""
    of = checkpoint(nodes.groupBy("fp").agg(F.min("node").alias("node")))
    pairs = linked(of.select("fp"), paths=True)
    ends = (of.select(F.col("fp").alias(x), F.col("node").alias(f"n{x}")) for x in "uv")
    for end in ends:
        pairs = pairs.join(end, end.columns[0])
    return pairs.select(F.least("nu", "nv").alias("a"), F.greatest("nu", "nv").alias("b"))


def labelled(rows: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of rows(id, h, text), and of each node its first row, how many rows it has, and its component."""
    prints = checkpoint(sketches(rows, shingle))
    row = F.struct((F.col("id") == NULL_ID).alias("none"), "id", "h")
    nodes = prints.groupBy("node").agg(F.min(row).alias("row"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = checkpoint(nodes)
    met = checkpoint(_met(nodes))
    pairs = checkpoint(met.where("size < 0").select("a", "b").unionByName(_simhash_pairs(nodes)).distinct())
    large = met.where("size >= 0").select(F.col("a").alias("bucket"), F.col("b").alias("node"), "size")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(large.select("node")).distinct()
    sets = checkpoint(_sets(rows, nodes.join(wanted, "node").select("node", "row.id", "row.h"), shingle))
    others = pairs.select(F.col("a").alias("team"), F.col("b").alias("node"), F.col("b").alias("component"), F.lit(False).alias("lead"))
    leads = pairs.select(*[F.col("a").alias(c) for c in ("team", "node", "component")], F.lit(True).alias("lead")).distinct()
    joined = components(_verified(others.unionByName(leads).join(sets, "node")))
    large = checkpoint(large.join(joined, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component")))
    more = _verified(split_join(checkpoint(_blocks(large)), sets, "node"))  # a node that leads many teams is a hot key
    found = components(joined.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    found = nodes.select("node", "row", "n").join(found, "node", "left")
    return prints.select("id", "h", "node"), checkpoint(found.withColumn("component", F.coalesce("component", "node")))


def least_of_each(rows: DataFrame, shingle: int) -> DataFrame:
    """id, h of the first row of each group of near copies, of rows(id, h, text)."""
    _, nodes = labelled(rows, shingle)
    return nodes.groupBy("component").agg(F.min("row").alias("row")).select("row.id", "row.h")


def groups(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, node, component_id (the smallest doc_id reachable by links) for each row of docs(doc_id, text). Texts without words are one node; a null doc_id is never the smallest, unless all are null."""
    prints, nodes = labelled(docs.select(*keys(F.col("doc_id"), F.col("text")), "text"), shingle)
    size = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = nodes.groupBy("component").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("nodes"))
    table = lookup(nodes.select("node", "n", "component"), least, "component", "nodes", size[0])
    out = lookup(prints, table.select("node", F.col("first.id").alias("first"), "n"), "node", "n", size[1])
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("id").alias("doc_id"), "node", real("first").alias("component_id"))


def brute_force(rows: list[tuple], shingle: int) -> list[tuple]:
    """doc_id and component_id that `groups` returns, from all pairs of sets of words' tuples."""
    sets = []
    for _, text in rows:
        words = re.findall(WORD.encode(), (text or "").encode("utf-8", "surrogatepass").lower())
        width = min(shingle, len(words))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j]) if alike(len(sets[i]), len(sets[j])) else -1
            if sets[i] == sets[j] or LIKE[1] * common >= LIKE[0] * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)), key=lambda k: rows[k][0])
                parent[b] = a
    return [(doc_id, rows[root(i)][0]) for i, (doc_id, _) in enumerate(rows)]
