"""Titles and file names: normalised titles, safe stems, byte prefixes, stream titles, orders. Unicode forms need Arrow UDFs; the rest is native."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrand import on_workers

#: Characters that no file name may hold. A fixed value.
UNSAFE = '/\\:*?"<>|'
NAME_BYTES = 240


def normal_title(title: Column) -> Column:
    """Case-folded, without accents, anything but a-z and 0-9 as single spaces, trimmed."""
    on_workers()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            plain = "".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c))
            return re.sub(r"[^a-z0-9]+", " ", plain).strip()

        return s.map(one)

    return run(title)


def safe_stem(title: Column) -> Column:
    """NFC, unsafe and control characters as _, runs of blanks as one, trimmed of ` ._-`; `track` if nothing is left."""
    on_workers()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            clean = "".join("_" if c in UNSAFE or unicodedata.category(c).startswith("C") else c for c in unicodedata.normalize("NFC", t))
            return re.sub(r"\s+", " ", clean).strip(" ._-") or "track"

        return s.map(one)

    return run(title)


def utf8_prefix(value: Column, limit: int) -> Column:
    """The longest head of whole characters within `limit` bytes."""
    chars = F.split(value, "")
    step = lambda s, c: F.when(s["open"] & (s["n"] + F.octet_length(c) <= limit), F.struct((s["n"] + F.octet_length(c)).alias("n"), F.lit(True).alias("open"), F.concat(s["t"], c).alias("t"))).otherwise(F.struct(s["n"].alias("n"), F.lit(False).alias("open"), s["t"].alias("t")))
    return F.aggregate(chars, F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"), F.lit("").alias("t")), step, lambda s: s["t"])


def stream_title(block: Column) -> Column:
    """The text between StreamTitle=' and the first ';, trimmed; null if it is empty or missing."""
    found = F.btrim(F.regexp_extract(block, r"(?s)StreamTitle='(.*?)';", 1), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(found != "", found)


def swapped(title: Column) -> Column:
    """`a - b` as `b - a` if it has exactly two parts that aren't empty."""
    parts = F.split(title, " - ")
    a, b = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    return F.when((F.size(parts) == 2) & (a != "") & (b != ""), F.concat_ws(" - ", b, a)).otherwise(title)


def metadata_order(url: Column, order: str, host: str, path: str) -> Column:
    """`preserve` or `title-artist`: as asked for, or for auto by one verified stream profile (host, path; no user, query, fragment, own port)."""
    if order in ("preserve", "artist-title"):
        return F.lit("preserve")
    if order == "title-artist":
        return F.lit("title-artist")
    if order != "auto":
        raise ValueError(f"unsupported metadata order: {order!r}")
    clean = F.coalesce(F.regexp_like(url, F.lit(rf"^(http://{re.escape(host)}(:80)?|https://{re.escape(host)}(:443)?){re.escape(path)}$")), F.lit(False))
    return F.when(clean, "title-artist").otherwise("preserve")


def untracked_label(seconds: Column) -> Column:
    """untracked_ and twelve digits of milliseconds, ties to even."""
    return F.format_string("untracked_%012d", F.bround(seconds * 1000).cast("long"))


def marked(title: Column, positive: tuple[str, ...], negative: tuple[str, ...]) -> Column:
    """Whether a normalised title holds a positive marker as whole words, and no negative one."""
    padded = F.concat(F.lit(" "), title, F.lit(" "))
    holds = lambda words: F.array_contains(F.array(*[padded.contains(f" {w} ") for w in words]), True) if words else F.lit(False)
    return (title != "") & holds(positive) & ~holds(negative)


def audio_codec(content_type: Column) -> Column:
    """aac or mp3 by a Content-Type header; null otherwise."""
    kind = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    return F.when(kind.isin("audio/aac", "audio/aacp"), "aac").when(kind.isin("audio/mpeg", "audio/mp3"), "mp3")
