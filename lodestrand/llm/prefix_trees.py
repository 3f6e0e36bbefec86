"""Substring dedup by prefix-partitioned suffix trees: every word in a repeated window of `window` words goes, wherever it stands.

See anchors.py for how suffixes are chosen and dealt. The splitters, sampled from the suffixes and as long as is needed to
divide them, bound groups of prefixes that fit in memory; within a group, suffixes with one head (their first words) have a
subtree. Its leaves are the distinct suffixes, in sorted order; an internal node is a run of leaves with a common prefix, as
deep as that has words. Leaves below a node agree on what follows; those that also agree on words before their places are
occurrences of a repeat, and the longest such agreement makes it maximal. Nodes of a head that goes on in the next group
are above both groups' subtrees: their windows are met across groups.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .anchors import Suffixes, Unit, common_prefixes, covered, marked, words_of
from .common import WORD, map_batches, slices, utf8

WINDOW = 35
RUN = 8


def internal_nodes(depth: np.ndarray, least: int, most: int):
    """Internal nodes of the tree over sorted leaves, deepest first: of each depth the leaves, and the node that each is below.

    depth: words that each leaf has in common with the one before. A node of depth d is a run of leaves between which no
    common prefix is shorter than d, and one is no longer.
    """
    for d in range(most, least - 1, -1):
        joint = np.flatnonzero(depth == d)
        if not len(joint):
            continue
        run = np.cumsum(depth < d)
        below = np.zeros(run[-1] + 1, bool)
        below[run[joint]] = True
        leaves = np.flatnonzero(below[run])
        yield d, leaves, run[leaves]


def maximal_repeats(s: Suffixes, open_: np.ndarray, unit: Unit):
    """Spans of repeated windows of each leaf, and the windows of open classes, each once: see anchors.resolve."""
    order, depth = common_prefixes(s.right, s.nr, s.width)
    rank = np.empty(len(s), np.int64)
    rank[common_prefixes(s.left, s.nl, s.width)[0]] = np.arange(len(s))
    rows, few, most = [], [], []
    for d, leaves, node in internal_nodes(depth, unit.k, unit.window):
        leaf = order[leaves]
        by = np.lexsort((rank[leaf], node))
        leaf, node = leaf[by], node[by]
        a, b = leaf[:-1], leaf[1:]
        differ = s.left[a] != s.left[b]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), s.left.shape[1])
        shared = np.where(node[1:] == node[:-1], np.minimum(shared, np.minimum(s.nl[a], s.nl[b])), -1)
        longest = np.maximum(np.append(shared, -1), np.append(-1, shared))  # of what stands before, with any leaf of the node
        deep = np.flatnonzero(longest + d >= unit.window)
        rows.append(leaf[deep])
        few.append(np.full(len(deep), unit.window - d))
        most.append(longest[deep])
    far, before, seen = [], [], set()
    for i in np.flatnonzero(open_).tolist():
        for b in range(unit.window - int(s.nr[i]), int(s.nl[i]) + 1):
            text = s.window(i, b, unit.window)
            if text not in seen:
                seen.add(text)
                far.append(i)
                before.append(b)
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *x]) for x in (rows, few, most)), (np.array(far, np.int64), np.array(before, np.int64))


def dedup(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) for each row of docs(doc_id, text).

    Rows equal in doc_id and text are one document, given out as often as they occur; no order decides, so there are no ties.
    Null texts have no words; texts under `window` words lose nothing; texts of any length are read whole; an empty table
    gives no rows. Other columns are not read.
    """
    unit = Unit(window, run, words=True)
    rows = marked(docs.select("doc_id", "text"), unit, False, maximal_repeats)
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("n_words long, n_removed long, kept string")])

    def strip(batches):
        for batch in batches:
            for piece in slices(batch):
                data, offsets = utf8(piece.column(1))
                raw = data.tobytes()
                begin, end, number = words_of(data, offsets)
                out = []
                for i, h in enumerate(piece.column(3).to_pylist()):
                    s, e = begin[number[i] : number[i + 1]], end[number[i] : number[i + 1]]
                    gone = covered(piece.column(4), i, h, len(s))
                    out.append((len(s), int(gone.sum()), b" ".join([raw[x:y] for x, y in zip(s[~gone].tolist(), e[~gone].tolist())]).decode("utf-8", "replace")))
                yield dict(zip(schema.names, (piece.column(0), *zip(*out))))

    return map_batches(rows, schema, strip)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs(doc_id, text): see `dedup` for nulls, repeated rows, empty and long texts and empty tables."""
    from pyspark.sql import functions as F

    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB's view of `digests`, by all windows; for tables of some megabytes.
DEDUP_SQL = """
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
n as (select doc_id, unnest(range(1, greatest(1, len(w) - 33))) as i, w from d),
g as (select doc_id, i, count(*) over (partition by s) > 1 as again from (select doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) as s from n)),
e as (select doc_id, p, sum(x) as x from (select doc_id, i as p, 1 as x from g where again union all select doc_id, i + 35, -1 from g where again) group by all),
b as (select doc_id, unnest(w) as y, generate_subscripts(w, 1) as p from d),
c as (select b.doc_id, b.p, y, sum(coalesce(x, 0)) over (partition by b.doc_id order by b.p rows unbounded preceding) > 0 as gone from b left join e on e.doc_id = b.doc_id and e.p = b.p)
select d.doc_id, cast(len(any_value(w)) as bigint) as n_words, count(*) filter (where gone) as n_removed, sha256(coalesce(string_agg(y, ' ' order by p) filter (where not gone), '')) as kept_sha256
from d left join c on c.doc_id = d.doc_id group by d.doc_id
"""


def brute_force(rows: list[tuple], window: int = WINDOW) -> list[tuple]:
    """What `digests` returns for rows (doc_id, text) with doc_ids that differ, by a dictionary of all windows."""
    from collections import Counter

    words = [re.findall(WORD, text or "") for _, text in rows]
    met = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if met[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out
