"""Suffix-array dedup of byte strings: of every repeated string of `window` bytes all occurrences but the earliest go.

See anchors.py for how suffixes are chosen, dealt between sampled splitters and compared across partitions. Within a
partition they are sorted by multikey quicksort, whose characters are eight bytes, and neighbours are compared: suffixes
between which all common prefixes are long enough hold the same bytes from their places on. What stands before the places
is sorted backwards in the same way. A window is repeated where both agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .anchors import Suffixes, Unit, common_prefixes, covered, marked
from .common import map_batches, slices, utf8

WINDOW = 100
RUN = 24


def neighbours(s: Suffixes, open_: np.ndarray, unit: Unit):
    """Windows met earlier, and the first of each window of open classes: see anchors.resolve. A window that starts b bytes before its place needs b equal bytes there and window - b after it."""
    right, after = common_prefixes(s.right, s.nr, s.width)
    left, before = common_prefixes(s.left, s.nl, s.width)
    rows, places, far, far_places = [], [], [], []
    one, two = np.empty(len(s), np.int64), np.empty(len(s), np.int64)
    for b in range(unit.window - unit.k + 1):
        own = np.flatnonzero((s.nl >= b) & (s.nr >= unit.window - b))
        if not len(own):
            continue
        one[right], two[left] = np.cumsum(after < unit.window - b), np.cumsum(before < b)
        same = one[own] * len(s) + two[own]
        by = np.argsort(same, kind="stable")  # rows are in the order of documents and places
        new = np.concatenate(([True], same[by][1:] != same[by][:-1]))
        for found, at, hit in ((rows, places, by[~new]), (far, far_places, by[new][open_[own[by[new]]]])):
            found.append(own[hit])
            at.append(np.full(len(hit), b))
    rows, places, far, far_places = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, places, far, far_places))
    return _spans(rows, places), (far, far_places)


def _spans(rows: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows at following places of a row as one span: row, first and last place."""
    order = np.lexsort((places, rows))
    rows, places = rows[order], places[order]
    begin = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (places[1:] - places[:-1] > 1)))) if len(rows) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(rows)) - 1 if len(rows) else begin
    return rows[begin], places[begin], places[end]


def dedup(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for each row of docs(doc_id, text).

    Earlier: a smaller doc_id (null is least; rows that share one are ordered by a hash of their texts), or an earlier start in
    the same document. Rows equal in doc_id and text are one document, given out as often as they occur. Null texts are empty;
    texts under `window` bytes lose nothing; texts of any length are read whole; an empty table gives no rows. Other columns are not read.
    """
    if run > window or window - run > 255:
        raise ValueError("window must be longer than run, by 255 at most")
    unit = Unit(window, run, words=False)
    rows = marked(docs.select("doc_id", "text"), unit, True, neighbours)
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept binary")])

    def strip(batches):
        for batch in batches:
            for piece in slices(batch):
                data, offsets = utf8(piece.column(1))
                hashes = piece.column(3).to_pylist()
                out = []
                for i, h in enumerate(hashes):
                    own = data[offsets[i] : offsets[i + 1]]
                    gone = covered(piece.column(4), i, h, len(own))
                    out.append((len(own), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), own[~gone].tobytes()))
                yield dict(zip(schema.names, (piece.column(0), *zip(*out))))

    return map_batches(rows, schema, strip)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs(doc_id, text): see `dedup` for nulls, ties, repeated rows, empty and long texts and empty tables."""
    from pyspark.sql import functions as F

    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB's view of `digests`, by all strings; for tables of some megabytes.
DEDUP_SQL = """
with d as (select doc_id, encode(coalesce(text, '')) as h from documents),
w as (select doc_id, unnest(range(1, greatest(1, octet_length(h) - 98))) as i, h from d),
g as (select doc_id, i, row_number() over (partition by s order by doc_id, i) > 1 as again from (select doc_id, i, md5(h[i : i + 99]) as s from w)),
e as (select doc_id, p, sum(x) as x from (select doc_id, i as p, 1 as x from g where again union all select doc_id, i + 100, -1 from g where again) group by all),
b as (select doc_id, unnest(range(1, octet_length(h) + 1)) as p, h from d),
c as (select b.doc_id, b.p, h[b.p : b.p] as y, sum(coalesce(x, 0)) over (partition by b.doc_id order by b.p rows unbounded preceding) > 0 as gone from b left join e on e.doc_id = b.doc_id and e.p = b.p),
r as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by p), false) as first from c)
select d.doc_id, octet_length(any_value(h)) as n_bytes, count(*) filter (where gone) as n_removed, count(*) filter (where first) as n_spans,
  sha256(unhex(coalesce(string_agg(hex(y), '' order by p) filter (where not gone), ''))) as kept_sha256
from d left join r on r.doc_id = d.doc_id group by d.doc_id
"""


def brute_force(rows: list[tuple], window: int = WINDOW) -> list[tuple]:
    """What `digests` returns for rows (doc_id, text) with doc_ids that differ, by a dictionary of all strings."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            s = data[i : i + window]
            if s in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc_id] = (doc_id, len(data), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest())
    return [out[r[0]] for r in rows]
