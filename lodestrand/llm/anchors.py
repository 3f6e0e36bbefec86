"""Repeated windows of tokens, found through a sparse suffix array.

Every window of `window` tokens chooses one of its places by its content alone: the start of the run of `k` tokens with
the least hash (the leftmost of equals). Equal windows choose the same place, so two equal windows have equal runs there,
and only suffixes that start at chosen places (about 2 in window - k + 2) need be looked at:

1. `repeated`: hashes of the runs at chosen places are counted; those met once go. A hash that a batch holds several
   times is sent once, and the batch's other places need no count, so a very common passage isn't a hot key.
2. `suffixes`: the rest are joined with their texts, which gives the suffix (`head`: the k tokens, `tail`: what follows
   within the windows) and what stands before it (`left`). A task sends equal ones' bytes once.
3. Suffixes are range-partitioned by their bytes between sampled splitters (ties by document and place, so that equal
   suffixes divide as well), and `resolve` finds repeated windows in each partition: an operator's own `match` sorts the
   distinct suffixes and compares them token by token. A class (suffixes with one head) that touches a partition's end may
   go on in the next: its windows are met across partitions by `across`, by XXH3-128 of their bytes.
4. Spans of repeated windows return to their texts.

The hashes of steps 1 and 2 only choose what is looked at; none of them decides that text goes.

Keys: rows that agree in doc_id and text are one document, given out as often as they occur. A null doc_id is less than
any other; its rows are told apart, and dealt, by a hash of the text. (doc_ids below -2^62 are ordered among the nulls.)
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, slices, spread, utf8

NULL_ID = -(1 << 63)
#: Hashes of runs known to be repeated that a task remembers, so that it sends each of them once by its hash.
MOST_HOT = 1 << 20
#: Tokens whose hashes are held at once.
CHUNK = 1 << 19
PLACE_BITS = 20
#: Suffixes of different kinds that `resolve` compares at once.
MOST_KINDS = 1 << 13
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
U64 = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(29)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(32)
    return h


@functools.lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    forth, back = _powers(base, 1 << max(12, (n + 1).bit_length()))
    return forth[: n + 1], back[: n + 1]


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values.astype(U64, copy=False) * powers(base, len(values))[0][:-1], out=total[1:])
    return total


def run_hashes(total: np.ndarray, base: int, length: int) -> np.ndarray:
    """A hash of each run of `length` values, the same wherever the run stands."""
    n = len(total) - length
    return mix((total[length:] - total[:n]) * powers(base, len(total))[1][:n])


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of v[i : i + width] for each i, from running minima of blocks of that width."""
    n = len(v)
    padded = np.full(-(-n // width) * width, np.iinfo(U64).max, U64)
    padded[:n] = v
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def chosen(values: np.ndarray, offsets: np.ndarray, window: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of row, place, first and last window start that chose it (all within the row), and the run's hash.

    values: the tokens of all rows; offsets: where each row's begin. Long input is met in chunks, which may give a place
    twice, with different windows.
    """
    low = U64((1 << PLACE_BITS) - 1)
    for start in range(0, max(0, int(offsets[-1]) - window + 1), CHUNK):
        part = values[start : start + CHUNK + window - 1]
        if len(part) < window:
            return
        hashes = run_hashes(prefix_sums(part, BASES[0]), BASES[0], k)
        place = (sliding_min((hashes & ~low) | np.arange(len(hashes), dtype=U64), window - k + 1) & low).astype(np.int64)
        n = len(place)
        row = np.searchsorted(offsets, np.arange(start, start + len(part)), side="right") - 1
        inside = row[:n] == row[window - 1 : window - 1 + n]
        change = place[1:] != place[:-1]
        first = np.flatnonzero(inside & np.concatenate(([True], change | ~inside[:-1])))
        last = np.flatnonzero(inside & np.concatenate((change | ~inside[1:], [True])))
        if len(first):
            at = place[first]
            home = row[first]
            begin = offsets[home] - start
            yield home, at - begin, first - begin, last - begin, hashes[at]


def words_of(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = IS_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all rows, and each row's first word's number (one more entry at the end)."""
    word = ~blank[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    before = np.concatenate(([False], word[:-1])) if len(word) else word
    after = np.concatenate((word[1:], [False])) if len(word) else word
    starts = np.flatnonzero(word & (~before | begins[:-1]))
    ends = np.flatnonzero(word & (~after | begins[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of each word's bytes. The words may be parts of a long buffer, which is met in chunks."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        begin = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, begin + CHUNK, side="right")))
        total = prefix_sums(data[begin : int(ends[to - 1])], base)
        s, e = starts[at:to] - begin, ends[at:to] - begin
        out[at:to] = mix((total[e] - total[s]) * powers(base, len(total))[1][s] + (e - s).astype(U64) * U64(BASES[1]))
        at = to
    return out


@dataclass(frozen=True)
class Unit:
    """Tokens: bytes, or words (runs of anything but white space)."""

    window: int
    k: int
    words: bool

    def values(self, data: np.ndarray, offsets: np.ndarray, base: int = BASES[0]) -> tuple[np.ndarray, np.ndarray]:
        if not self.words:
            return data, offsets
        starts, ends, first = words_of(data, offsets)
        return word_values(data, starts, ends, base), first


def key_of(text) -> Column:
    """doc_id as a long; rows without one have a key by their text, so that they spread."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID) + F.xxhash64(text).bitwiseAND((1 << 62) - 1))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, key and hash (a number that tells different texts of one key apart), dealt by key: the one shuffle of texts, which both joins below share."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), key_of(text).alias("key")).repartition(spread(docs), "key")
    return rows.withColumn("hash", F.dense_rank().over(Window.partitionBy("key").orderBy(F.xxhash64("text"))))


def repeated(docs: DataFrame, unit: Unit, parts: int) -> DataFrame:
    """key and places: chosen places whose run of k tokens is met at another place too. It may hold a few others."""
    rows = docs.select(key_of(F.coalesce("text", F.lit(""))).alias("key"), "text")

    def choose(batches):
        hot = np.zeros(0, U64)
        for batch in batches:
            for piece in slices(batch):
                keys = piece.column(0).to_numpy(zero_copy_only=False)
                for row, place, first, last, h in chosen(*unit.values(*utf8(piece.column(1))), unit.window, unit.k):
                    where = ((place << 8 | (place - first)) << 8 | (last - first)) << 1
                    order = np.argsort(h, kind="stable")
                    same = h[order][1:] == h[order][:-1]
                    follows = np.zeros(len(h), bool)
                    follows[order[1:]] = same
                    sure = follows.copy()
                    sure[order[:-1]] |= same
                    if len(hot):  # sent by an earlier piece
                        met = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                        follows |= met
                        sure |= met
                    if len(hot) < MOST_HOT:
                        hot = np.union1d(hot, h[order[1:][same]])
                    where |= sure
                    # those after the first are known to be repeated: any partition does, the same one for a document's
                    h = np.where(follows, mix(keys[row].astype(U64) + U64(BASES[1])), h)
                    yield {"h": h.view(np.int64), "key": keys[row], "where": where}

    def count(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches]
        if not parts:
            return
        h, key, where = map(np.concatenate, zip(*parts))
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        keep = (where & 1).astype(bool)
        keep[order[1:]] |= same
        keep[order[:-1]] |= same
        yield {"key": key[keep], "where": where[keep] >> 1}

    pairs = map_batches(rows, T._parse_datatype_string("h long, key long, where long"), choose).repartition(parts, "h")
    found = map_batches(pairs, T._parse_datatype_string("key long, where long"), count)
    return found.groupBy(F.col("key").alias("k")).agg(F.collect_list("where").alias("places"))


#: Kinds of suffixes that a task remembers, to send each one's bytes once.
MOST_KNOWN = 1 << 18
SUFFIX = "head binary, tail binary, left binary, key long, hash int, start long, length int"


class Known:
    """What a task has sent: a suffix equal to an earlier one needs no bytes, as what becomes of it is known."""

    def __init__(self, keep_first: bool):
        self.keep_first, self.sent = keep_first, {}

    def decided(self, head: bytes, tail: bytes, left: bytes, place: tuple[int, int, int]) -> list[tuple[int, int, int]] | None:
        """None: send it. Else the places whose spans are repeated."""
        digest = (xxhash.xxh3_128_digest(head + tail + left), len(head), len(left))
        first = self.sent.get(digest)
        if first is None:
            if len(self.sent) >= MOST_KNOWN:
                self.sent.clear()
            self.sent[digest] = place
            return None
        if first is SEEN:
            return [place]
        if place == first:  # a repeated row
            return []
        if self.keep_first:
            return [place] if place > first else None
        self.sent[digest] = SEEN
        return [first, place]


SEEN = (1 << 63, 0, 0)


def suffixes(texts: DataFrame, places: DataFrame, unit: Unit, keep_first: bool) -> DataFrame:
    """head, tail, left (binary; words are joined by one space), key, hash, start (token of the first window), length 0; or, without bytes, a span that is known to be repeated, with its length in tokens."""
    rows = texts.join(places, texts["key"] == places["k"]).select("doc_id", "text", "key", "hash", "places")
    window, k = unit.window, unit.k

    def cut(batches):
        known = Known(keep_first)
        for batch in batches:
            for piece in slices(batch):
                out = {n: [] for n in ("head", "tail", "left", "key", "hash", "start", "length")}
                add = [out[n].append for n in out]
                wheres = piece.column(4)
                bounds = wheres.offsets.to_numpy()
                flat = wheres.values.to_numpy()
                data, offsets = utf8(piece.column(1))
                raw = data.tobytes()
                if unit.words:
                    begin, end, number = words_of(data, offsets)
                for i, (key, h) in enumerate(zip(piece.column(2).to_pylist(), piece.column(3).to_pylist())):
                    where = np.unique(flat[bounds[i] : bounds[i + 1]])
                    place, before, after = where >> 16, where >> 8 & 255, where & 255
                    first = place - before
                    size = int(number[i + 1] - number[i] if unit.words else offsets[i + 1] - offsets[i])
                    fits = (first >= 0) & (first + after + window <= size)
                    place, first, after = place[fits], first[fits], after[fits]
                    if unit.words:
                        s, e = begin[number[i] : number[i + 1]], end[number[i] : number[i + 1]]
                        at = np.concatenate(([0], np.cumsum(e - s + 1))).tolist()
                        text, gap = b" ".join([raw[x:y] for x, y in zip(s.tolist(), e.tolist())]), 1
                    else:
                        at, text, gap = range(size + 1), raw[offsets[i] : offsets[i + 1]], 0
                    for p, a, z in zip(place.tolist(), first.tolist(), (first + after + window).tolist()):
                        head = text[at[p] : at[p + k] - gap]
                        tail = text[at[p + k] : at[z] - gap] if z > p + k else b""
                        left = text[at[a] : at[p] - gap] if p > a else b""
                        gone = known.decided(head, tail, left, (key, h, a))
                        values = [(head, tail, left, key, h, a, 0)] if gone is None else [(None, None, None, *q, z - a) for q in gone]
                        for row in values:
                            for put, value in zip(add, row):
                                put(value)
                yield out

    return map_batches(rows, T._parse_datatype_string(SUFFIX), cut)


def kinds(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each suffix the number of its kind (equal head, tail and left); one suffix of each kind; each kind's class (equal heads); and whether a class holds the least or the greatest head."""
    code = np.zeros(table.num_rows, np.int64)
    for i in range(3):
        coded = table.column(i).combine_chunks().dictionary_encode()
        code = code * len(coded.dictionary) + coded.indices.to_numpy()
        if i:  # numbers stay small
            code = np.unique(code, return_inverse=True)[1].ravel()
        else:
            heads, group = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    _, first, kind = np.unique(code, return_index=True, return_inverse=True)
    ends = np.zeros(len(heads), bool)
    ends[[heads.index(min(heads)), heads.index(max(heads))]] = True
    return kind.ravel(), first, group[first], ends


@dataclass(frozen=True)
class Suffixes:
    """Suffixes of different kinds as rows of characters: from the chosen place on (right), and backwards from it (left).

    A character holds `width` tokens: eight bytes as one number, or one word by its number in a dictionary of these
    suffixes' words. Rows are padded with 0; nr and nl count their tokens. text: left, head and tail in one.
    """

    right: np.ndarray
    left: np.ndarray
    nr: np.ndarray
    nl: np.ndarray
    width: int
    text: list[bytes]

    def __len__(self) -> int:
        return len(self.text)

    def window(self, i: int, before: int, length: int) -> bytes:
        """The bytes of the window of row i that starts `before` tokens ahead of the chosen place."""
        at = int(self.nl[i]) - before
        return self.text[i][at : at + length] if self.width > 1 else b" ".join(self.text[i].split(b" ")[at : at + length])


def _padded(strings: list[bytes]) -> np.ndarray:
    """Big-endian eight-byte characters; lengths come last, so that a text and the same with more zero bytes differ."""
    lengths = np.array([len(s) for s in strings], np.int64)
    wide = -(-max(1, int(lengths.max(initial=0))) // 8) * 8
    padded = np.zeros((len(strings), wide), np.uint8)
    padded[np.arange(wide) < lengths[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    return np.concatenate([padded.view(">u8").astype(U64), lengths.astype(U64)[:, None]], axis=1)


def suffix_rows(unit: Unit, table: pa.Table) -> Suffixes:
    """table: head, tail, left of suffixes of different kinds."""
    heads, tails, lefts = (c.to_pylist() for c in table.columns)
    if not unit.words:
        rights = [h + t for h, t in zip(heads, tails)]
        count = lambda strings: np.array([len(s) for s in strings], np.int64)
        return Suffixes(_padded(rights), _padded([s[::-1] for s in lefts]), count(rights), count(lefts), 8, [a + b for a, b in zip(lefts, rights)])
    text = [b" ".join([x for x in parts if x]) for parts in zip(lefts, heads, tails)]
    nl = np.array([s.count(b" ") + 1 if s else 0 for s in lefts], np.int64)
    n = np.array([s.count(b" ") + 1 for s in text], np.int64)
    # each word with the blank after it is a value of its own
    data = b" ".join(text) + b" "
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20) + 1
    offsets = pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64))
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, offsets, pa.py_buffer(data)])
    codes = np.append(words.dictionary_encode().indices.to_numpy().astype(np.int64) + 1, 0)
    begin = np.cumsum(n) - n

    def rows(first: np.ndarray, count: np.ndarray, step: int) -> np.ndarray:
        place = np.arange(max(1, int(count.max(initial=0))))
        at = first[:, None] + step * place
        return codes[np.where(place < count[:, None], at, len(codes) - 1)]

    return Suffixes(rows(begin + nl, n - nl, 1), rows(begin + nl - 1, nl, -1), n - nl, nl, 1, text)


def multikey_quicksort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of characters, and how many characters each row has in common with the one before it.

    Each round divides all groups at once, each by its pivot in the character that the group has come to: what is less and
    what is greater stays at that character, what is equal goes on to the next.
    """
    n, most = rows.shape
    order, common = np.arange(n), np.full(n, most)
    common[:1] = 0
    start, size, depth = np.array([0]), np.array([n]), np.array([0])
    while True:
        some = (size > 1) & (depth < most)
        start, size, depth = start[some], size[some], depth[some]
        if not len(start):
            return order, common
        begin = np.cumsum(size) - size
        group = np.repeat(np.arange(len(start)), size)
        at = np.arange(len(group)) + (start - begin)[group]
        members = order[at]
        character = rows[members, depth[group]]
        pivot = character[begin + size // 2][group]
        side = 3 * group + (character > pivot) + (character >= pivot)
        order[at] = members[np.argsort(side, kind="stable")]
        less, equal, more = np.bincount(side, minlength=3 * len(start)).reshape(-1, 3).T
        middle, end = start + less, start + less + equal
        common[middle[less > 0]] = depth[less > 0]
        common[end[more > 0]] = depth[more > 0]
        start, size, depth = np.concatenate([start, middle, end]), np.concatenate([less, equal, more]), np.concatenate([depth, depth + 1, depth])


def common_prefixes(rows: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows, and the tokens that each has in common with the one before it (the LCP array)."""
    order, common = multikey_quicksort(rows)
    a, b, depth = order[:-1], order[1:], common[1:]
    tokens = depth * width
    if width > 1:  # equal bytes at the head of the first character that differs
        last = rows.shape[1] - 1
        differ = rows[a, np.minimum(depth, last)] ^ rows[b, np.minimum(depth, last)]
        tokens += np.where(depth <= last, sum((differ < U64(1 << 8 * i)).astype(np.int64) for i in range(8)), 0)
    return order, np.concatenate(([0], np.minimum(tokens, np.minimum(lengths[a], lengths[b]))))


FOUND = "key long, hash int, start long, length int, w1 long, w2 long"
#: rows, before (tokens from a window's start to the chosen place): of windows, or of spans of windows by their first and last.
Match = Callable[[Suffixes, np.ndarray, Unit], tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]


def resolve(rows: DataFrame, unit: Unit, keep_first: bool, match: Match) -> DataFrame:
    """Of each partition of suffixes: repeated spans (length > 0), and windows that must be met across partitions (length 0).

    match(suffixes, open, unit): of suffixes of different kinds, in the order of their documents and places, the repeated
    windows (row, fewest and most tokens before the place), and, of those whose class may go on elsewhere (open), each
    window once, as its first row and the tokens before.
    """
    window = unit.window

    def work(batches):
        held = []
        for batch in batches:
            done = batch.filter(batch.column(0).is_null())
            if done.num_rows:
                yield spans(*(done.column(i).to_numpy() for i in range(3, 7)))
            if done.num_rows < batch.num_rows:
                held.append(batch.filter(batch.column(0).is_valid()))
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        del held
        kind, _, classes, ends = kinds(table)
        key, h, start = (table.column(i).to_numpy() for i in range(3, 6))
        order = np.lexsort((start, h, key, kind))
        key, h, start, kind = key[order], h[order], start[order], kind[order]
        again = np.zeros(len(order), bool)  # repeated rows are one document
        again[1:] = (kind[1:] == kind[:-1]) & (key[1:] == key[:-1]) & (h[1:] == h[:-1]) & (start[1:] == start[:-1])
        if again.any():
            order, key, h, start, kind = (x[~again] for x in (order, key, h, start, kind))
        group = classes[kind]
        fresh = np.concatenate(([True], kind[1:] != kind[:-1]))
        gone = ~fresh if keep_first else ~(fresh & np.concatenate((fresh[1:], [True])))
        rows_gone = order[gone]
        yield spans(key[gone], h[gone], start[gone], span_lengths(unit, table.select([0, 1, 2]).take(pa.array(rows_gone))))
        # classes of several kinds: their windows differ in part; so may those of a class that goes on elsewhere
        open_ = ends[group]
        several = np.bincount(group[fresh], minlength=len(ends)) > 1
        left = np.flatnonzero(fresh & (open_ | several[group]))
        left = left[np.argsort(group[left], kind="stable")]
        at = 0
        while at < len(left):
            to = min(len(left), at + MOST_KINDS)
            while to < len(left) and group[left[to]] == group[left[to - 1]] and not open_[left[to]]:
                to += 1  # a class that isn't open is met at once
            some = left[at:to]
            at = to
            content = table.select([0, 1, 2])
            lengths = head_places(unit, content.take(pa.array(order[some])))
            some = some[np.lexsort((start[some] + lengths, h[some], key[some]))]
            found = suffix_rows(unit, content.take(pa.array(order[some])))
            place = start[some] + found.nl
            (row, few, most), (far, before) = match(found, open_[some], unit)
            here = some[row]
            yield spans(key[here], h[here], place[row] - most, window + most - few)
            if len(far):
                here = some[far]
                digests = b"".join(xxhash.xxh3_128_digest(found.window(i, b, window)) for i, b in zip(far.tolist(), before.tolist()))
                w1, w2 = np.frombuffer(digests, np.int64).reshape(-1, 2).T
                yield {"key": key[here], "hash": h[here], "start": place[far] - before, "length": np.zeros(len(far), np.int32), "w1": w1, "w2": w2}

    return map_batches(rows, T._parse_datatype_string(FOUND), work)


def head_places(unit: Unit, table: pa.Table) -> np.ndarray:
    """Tokens before each suffix's chosen place."""
    lefts = table.column(2).to_pylist()
    return np.array([s.count(b" ") + 1 if s and unit.words else len(s) for s in lefts], np.int64)


def span_lengths(unit: Unit, table: pa.Table) -> np.ndarray:
    """Tokens of each row's span."""
    import pyarrow.compute as pc

    if not unit.words:
        return sum(pc.binary_length(c).to_numpy() for c in table.columns)
    columns = [c.to_pylist() for c in table.columns]
    return np.array([sum(x.count(b" ") + 1 for x in parts if x) for parts in zip(*columns)], np.int64)


def spans(key, h, start, length) -> dict:
    zero = np.zeros(len(key), np.int64)
    return {"key": key, "hash": h, "start": start, "length": np.asarray(length, np.int32), "w1": zero, "w2": zero}


def runs(key, h, start, window: int) -> tuple[np.ndarray, ...]:
    """Windows at consecutive starts of a document as one span."""
    order = np.lexsort((start, h, key))
    key, h, start = key[order], h[order], start[order]
    if not len(key):
        return key, h, start, start
    cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (h[1:] != h[:-1]) | (start[1:] - start[:-1] > 1))))
    last = np.concatenate((cut[1:], [len(key)])) - 1
    return key[cut], h[cut], start[cut], start[last] - start[cut] + window


SPAN = "key long, hash int, start long, length int"


def across(found: DataFrame, unit: Unit, keep_first: bool, parts: int) -> DataFrame:
    """All repeated spans (key, hash, start, length): those found, and those of windows that partitions have in common.

    A partition sends a window once at most, so a window has no more rows than there are partitions.
    """
    names = ("key", "hash", "start", "length")

    def meet(batches):
        held = []
        for batch in batches:
            length = batch.column(3).to_numpy()
            whole = batch.filter(pa.array(length > 0))
            if whole.num_rows:
                yield {n: whole.column(i) for i, n in enumerate(names)}
            if whole.num_rows < batch.num_rows:
                held.append(batch.filter(pa.array(length == 0)))
        if held:
            key, h, start, _, w1, w2 = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
            by = np.lexsort((start, h, key, w2, w1))
            new = np.concatenate(([True], (w1[by][1:] != w1[by][:-1]) | (w2[by][1:] != w2[by][:-1])))
            hit = by[~new if keep_first else ~(new & np.concatenate((new[1:], [True])))]
            key, h, start, length = runs(key[hit], h[hit], start[hit], unit.window)
            yield {"key": key, "hash": h, "start": start, "length": length.astype(np.int32)}

    return map_batches(found.repartition(parts, F.when(F.col("length") > 0, F.col("key")).otherwise(F.col("w1"))), T._parse_datatype_string(SPAN), meet)


def marked(docs: DataFrame, unit: Unit, keep_first: bool, match: Match) -> DataFrame:
    """doc_id, text, hash and marks (array of hash, start, length: spans of tokens in repeated windows; null: none) for each row of docs(doc_id, text)."""
    parts = spread(docs)
    texts = keyed(docs)
    rows = suffixes(texts, repeated(docs, unit, parts), unit, keep_first)
    rows = rows.repartitionByRange(2 * parts, "head", "tail", "left", "key", "hash", "start")
    found = across(resolve(rows, unit, keep_first, match), unit, keep_first, parts)
    marks = found.groupBy(F.col("key").alias("k")).agg(F.collect_list(F.struct("hash", "start", "length")).alias("marks"))
    return texts.join(marks, texts["key"] == F.col("k"), "left").select("doc_id", "text", "key", "hash", "marks")


def covered(marks: pa.ListArray, i: int, h: int, n: int) -> np.ndarray:
    """Which of the n tokens of row i the marks with its hash cover."""
    depth = np.zeros(n + 1, np.int64)
    a, b = marks.offsets[i].as_py(), marks.offsets[i + 1].as_py()
    if b > a:
        own = marks.values.slice(a, b - a)
        hit = own.field(0).to_numpy() == h
        start, length = own.field(1).to_numpy()[hit], own.field(2).to_numpy()[hit]
        np.add.at(depth, start, 1)
        np.add.at(depth, start + length, -1)
    return np.cumsum(depth[:-1]) > 0
