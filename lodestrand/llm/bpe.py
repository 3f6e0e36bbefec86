"""Byte-level BPE by monoid tree reduction.

A text is halved until leaves are short; leaves are encoded on their own, and neighbours are joined by re-encoding a
window around the seam. Windows grow until what is outside provably stays as it is, by one of two rules:

* A *certain* boundary: a white-space character after one that is none. No match of the public pattern holds such a place
  in its inside, none that ends before it looks beyond it, and the pattern never looks back, so tokens on either side are
  those of the whole text, whatever stands around it. If there are such places near the seam, the window ends at them.
* Within one match, a sequence of tokens is the encoding of its bytes if and only if each two neighbours are the encoding
  of theirs, as merges go by rank alone. In a long stretch without certain boundaries, the match across the seam is found,
  and of its two halves' tokens a window is encoded again that takes in more tokens, two, four, eight, until it agrees with
  its neighbours on both sides.

Decoding joins bytes up the same kind of tree.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text

#: Texts of up to so many characters are encoded at once; a certain boundary is looked for as far from a seam.
LEAF_CHARS = 512
LEAF_TOKENS = 512
BLANK = frozenset(" \n\t\r")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TreeBpe:
    """encode(text) gives the ids, decode(ids) the bytes."""

    def __init__(self, ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS):
        import regex
        import tiktoken

        ranks = read_ranks(ranks_path)
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf, self.piece = encoding.encode_ordinary, encoding._encode_single_piece
        self.matches = regex.compile(pattern).finditer
        self.leaf_chars = max(1, leaf_chars)
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf_chars:
            return self.leaf(text[start:end])
        middle = (start + end) // 2
        return self._join(text, start, middle, end, self._encode(text, start, middle), self._encode(text, middle, end))

    def _join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[start:end] from those of its halves, which may be changed."""
        low, high = self._certain(text, middle - 1, start, -1), self._certain(text, middle + 1, end, 1)
        if high - low > 2 * self.leaf_chars and (inside := self._across(text, low, middle, high, left, right)):
            before, window, after = inside
        else:
            before, after = self._tokens(left, True, text[low:middle]), self._tokens(right, False, text[middle:high])
            window = self.leaf(text[low:high])
        del left[len(left) - before :]
        left += window
        left += right[after:] if after else right
        return left

    @staticmethod
    def _certain(text: str, place: int, limit: int, step: int) -> int:
        """The nearest certain boundary from place on towards limit, or limit."""
        while place != limit:
            if text[place] in BLANK and place and not text[place - 1].isspace() and (step > 0 or place - 1 >= limit):
                return place
            place += step
        return limit

    def _tokens(self, ids: list[int], at_end: bool, text: str) -> int:
        """How many ids from the seam on cover text; they end exactly there, as a boundary is certain on either side alone."""
        count = self._covering(ids, at_end, len(text.encode()))
        if count is None:
            raise AssertionError("a token crosses a certain boundary")
        return count

    def _covering(self, ids: list[int], at_end: bool, n_bytes: int) -> int | None:
        count = 0
        while n_bytes > 0:
            n_bytes -= len(self.token[ids[-1 - count] if at_end else ids[count]])
            count += 1
        return None if n_bytes else count

    def _across(self, text: str, low: int, middle: int, high: int, left: list[int], right: list[int]) -> tuple[int, list[int], int] | None:
        """Tokens of left and of right to replace, and by which, if one match of text[low:high] crosses the seam and both halves' matches end and begin with its parts. None else."""
        last, match = None, None
        for match in self.matches(text, low, high):
            if match.end() > middle:
                break
            last = match
        if match is None or match.end() <= middle:
            return None
        a, b = match.span()
        if a == middle:
            return (0, [], 0) if last is not None and self._last(text, low, middle) == last.start() else None
        first = next(self.matches(text, middle, high))
        if self._last(text, low, middle) != a or first.span() != (middle, b):
            return None
        before, after = self._covering(left, True, len(text[a:middle].encode())), self._covering(right, False, len(text[middle:b].encode()))
        if before is None or after is None:
            return None
        one, two = left[len(left) - before :], right[:after]
        i, j = min(1, len(one)), min(1, len(two))
        while True:
            window = self.piece(b"".join(map(self.token.__getitem__, one[len(one) - i :] + two[:j])))
            fits = i == len(one) or self._agree(one[len(one) - i - 1], window[0])
            fits_after = j == len(two) or self._agree(window[-1], two[j])
            if fits and fits_after:
                return i, window, j
            i, j = (i if fits else min(len(one), 2 * i)), (j if fits_after else min(len(two), 2 * j))

    def _last(self, text: str, low: int, middle: int) -> int:
        """Where the last match of text[low:middle] begins."""
        at = low
        for match in self.matches(text, low, middle):
            at = match.start()
        return at

    def _agree(self, one: int, two: int) -> bool:
        return self.piece(self.token[one] + self.token[two]) == [one, two]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.token.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep` and `ids` array<int> for each row. A null text has no ids; repeated rows stay repeated."""

    def factory():
        bpe = TreeBpe(ranks_path, pattern)
        return lambda t: (bpe.encode(t),)

    return per_text(docs, "ids array<int>", factory, keep, text)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep`, `ids` array<int> and `decoded` binary, which the ids decode to. A null text is an empty one."""

    def factory():
        bpe = TreeBpe(ranks_path, pattern)

        def both(t):
            ids = bpe.encode(t)
            return ids, bpe.decode(ids)

        return both

    return per_text(docs, "ids array<int>, decoded binary", factory, keep, text)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs(doc_id, text).

    A null text is an empty one, without ids. Texts of any length are encoded whole, each in one task, whose memory grows with
    the text alone. Repeated rows stay, each with its digests; there are no ties to break. An empty table gives no rows.
    Other columns are not read.
    """
    out = round_trip(docs, ranks_path, pattern)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
