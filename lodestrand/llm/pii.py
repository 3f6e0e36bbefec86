"""Personal data by weak supervision.

Candidates are the base spans of four kinds and looser ones of the same kinds. Labelers vote on each (yes, no or nothing):
form, checksum and number of digits, a gazetteer, cue words nearby, and what touches the span. All votes of the corpus are
counted by pattern; expectation-maximisation estimates from the counts how reliable each labeler is, without labels. The
posteriors train the final span classifier, a logistic model over votes, pairs of votes and shape, which decides on the
looser candidates. Base spans always stay.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, per_text, slices

KINDS = ("email", "ip", "card", "phone")
#: Fixed values of the gazetteer: frequent top-level domains, calling codes, leading digits of card issuers, private or reserved first octets.
DOMAINS = frozenset("com org net edu gov mil int info biz io co de fr es it nl be ch at uk us ca au eu pl se no dk fi pt ie cz ru jp cn in br mx ar cl".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "380", "420", "421", "971", "972")
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "22", "23", "24", "25", "26", "27", "35", "36", "62")
#: Cue words near a span, in English, German, French and Spanish; those of `not` speak against any kind.
CUES = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel", "write to", "reach me"),
    "ip": ("ip", "address", "adresse", "server", "host", "dirección", "serveur"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "ruf", "appel", "llam", "móvil", "whatsapp"),
    "not": ("version", "license", "licence", "isbn", "issn", "order", "invoice", "token", "sha", "commit", "doi", "page", "chapter", "v."),
}
AROUND = 40
ACCEPT = 0.9
LABELERS = 5

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive runs and the look behind keep these linear on long runs of digits; the matches are those of the plain patterns
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{1,63}){1,5}", re.I),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "phone": re.compile(r"(?:\+[0-9]{1,3}[ .-]|(?<![0-9+.-])(?:00[1-9][0-9]{0,2}[ .-])?)\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9-])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with a local part before it (up to the last match) and a domain after it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans, by kind, then start."""
    out = [("email", *s) for s in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return out


def loose_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Looser candidates that touch none of the taken spans, nor one another."""
    found = []
    lower = text.lower() if "at" in text or "AT" in text else ""
    if lower and ("(at)" in lower or "[at]" in lower or "{at}" in lower or (" at " in lower and " dot " in lower)):
        found += [("email", *m.span()) for m in LOOSE["email"].finditer(text)]
    if DIGIT.search(text):
        if ":" in text:
            found += [("ip", *m.span()) for m in LOOSE["ip"].finditer(text)]
        found += [("phone", *m.span()) for m in LOOSE["phone"].finditer(text)]
        found += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(m[0].replace(" ", "").replace("-", "")) <= 19]
    if DIGIT.search(text):
        found += [("card", *m.span()) for m in LOOSE["card"].finditer(text)]
    # taken spans as disjoint ones in order, and the end of the last that was found
    starts, ends, last = [], [], 0
    for _, a, b in sorted(taken, key=lambda s: s[1]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        at = bisect.bisect_left(starts, b)
        if a >= last and (not at or ends[at - 1] <= a):
            out.append((kind, a, b))
            last = b
    return out


def votes(text: str, kind: str, a: int, b: int) -> tuple[int, ...]:
    """form, check, gazetteer, context, touch: 1 for, 0 nothing, -1 against."""
    span = text[a:b]
    digits = "".join(c for c in span if "0" <= c <= "9")
    before = text[max(0, a - AROUND) : a].lower()
    around = before + " " + text[b : b + AROUND // 2].lower()
    context = 1 if any(c in around for c in CUES[kind]) else 0
    if any(c in before[-20:] for c in CUES["not"]):
        context = -1
    touch = -1 if (a and text[a - 1].isalnum() and kind != "email") or (b < len(text) and text[b].isalnum()) else 1
    if kind == "email":
        form = 1 if "@" in span else 0
        check = 1 if re.search(r"[A-Za-z]", span) else -1
        gazetteer = 1 if re.split(r"[^a-z0-9]+", span.lower().rstrip(")]}"))[-1] in DOMAINS else -1
    elif kind == "ip":
        form = 1 if span.count(".") == 3 or span.count(":") == 7 else -1
        parts = span.split(".")
        check = 1 if ":" in span or not any(len(p) > 1 and p[0] == "0" for p in parts) else -1
        gazetteer = 0 if ":" in span else (-1 if int(parts[0][-3:]) in (0, 255) or span.count(".0") == 3 else 1)
    elif kind == "card":
        form = 1 if re.fullmatch(r"[0-9]{13,19}|[0-9]{4}([ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", span) else -1
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits.startswith(ISSUERS) else -1
    else:
        form = 1 if span[0] in "+(" or span.startswith("00") else 0
        check = 1 if 8 <= len(digits) <= 15 else -1
        code = digits[2:] if span.startswith("00") else digits
        gazetteer = (1 if code.startswith(CALLING) else -1) if span[0] == "+" or span.startswith("00") else 0
    return form, check, gazetteer, context, touch


def candidates(text: str) -> list[tuple[str, int, int, bool, tuple[int, ...]]]:
    base = base_spans(text)
    return [(k, a, b, is_base, votes(text, k, a, b)) for is_base, spans in ((True, base), (False, loose_spans(text, base))) for k, a, b in spans]


def pattern(kind: str, is_base: bool, v: tuple[int, ...]) -> str:
    return f"{kind}{int(is_base)}" + "".join("-0+"[x + 1] for x in v)


def histogram(docs: DataFrame, text: str = "text") -> DataFrame:
    """pattern, n: how many candidates of all documents have each pattern of kind and votes (2 * 4 * 3^5 patterns at most)."""
    schema = T._parse_datatype_string("pattern string, n long")

    def run(batches):
        found = Counter()
        for batch in batches:
            for piece in slices(batch, text):
                for t in piece.column(0).to_pylist():
                    if t:
                        found.update(pattern(k, is_base, v) for k, _, _, is_base, v in candidates(t))
        yield {"pattern": list(found), "n": list(found.values())}

    return map_batches(docs.select(text), schema, run).groupBy("pattern").agg(F.sum("n").alias("n"))


def reliabilities(patterns: list[tuple[str, int]], rounds: int = 100) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of each pattern, and P(vote | class) as [class, labeler, vote], by expectation-maximisation over the counts.

    Votes are taken as independent given the class; each kind has a prior of its own. It starts from the majority of votes,
    and counts are smoothed by one.
    """
    if not patterns:
        return {}, np.full((2, LABELERS, 3), 1 / 3)
    kind = np.array([next(i for i, k in enumerate(KINDS) if p.startswith(k)) for p, _ in patterns])
    vote = np.array([["-0+".index(c) for c in p[-LABELERS:]] for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    post = np.clip(0.5 + 0.12 * (vote - 1).sum(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        weight = np.stack([n * (1 - post), n * post])
        table = np.ones((2, LABELERS, 3))
        for j in range(LABELERS):
            for c in range(3):
                table[:, j, c] += weight[:, vote[:, j] == c].sum(axis=1)
        table /= table.sum(axis=2, keepdims=True)
        prior = np.array([[1 + w[kind == k].sum() for k in range(len(KINDS))] for w in weight])
        prior /= prior.sum(axis=0)
        log = np.log(prior[:, kind]) + np.log(table[:, np.arange(LABELERS)[:, None], vote.T]).sum(axis=1)
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return {p: float(x) for (p, _), x in zip(patterns, post)}, table


def features(p: str) -> np.ndarray:
    """Kind, votes, and whether the votes for outweigh those against."""
    vote = np.array(["-0+".index(c) - 1 for c in p[-LABELERS:]], float)
    kind = [float(p.startswith(k)) for k in KINDS]
    return np.array([*kind, *(vote > 0), *(vote < 0), vote[0] * vote[1], vote[1] * vote[2], float(vote.sum() > 1)])


def train(patterns: list[tuple[str, int]], posterior: dict[str, float], steps: int = 60, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic model of the posteriors, each pattern as often as it is met (on a logarithmic scale, so that rare ones count)."""
    x = np.array([features(p) for p, _ in patterns])
    y = np.array([posterior[p] for p, _ in patterns])
    n = np.log1p([c for _, c in patterns])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (p - y)) + ridge * w)
    return w


def classifier(docs: DataFrame) -> frozenset[str]:
    """The patterns of looser candidates that the final classifier accepts, learnt from all documents."""
    patterns = sorted((r.pattern, r.n) for r in histogram(docs).collect())  # 1,944 rows at most
    if not patterns:
        return frozenset()
    weights = train(patterns, reliabilities(patterns)[0])
    return frozenset(p for p, _ in patterns if 1 / (1 + np.exp(-features(p) @ weights)) >= ACCEPT)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame, accepted: frozenset[str] | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep`, base and found: arrays of spans (kind, from, to; code points, end exclusive) by kind, then start, for each row.

    Null and empty texts have none; repeated rows stay; an empty table gives no rows.
    """
    accepted = classifier(docs) if accepted is None else accepted

    def factory():
        def work(t):
            base, more = [], []
            for kind, a, b, is_base, v in candidates(t):
                if is_base:
                    base.append((kind, a, b))
                elif pattern(kind, False, v) in accepted:
                    more.append((kind, a, b))
            order = lambda s: (KINDS.index(s[0]), s[1], s[2])
            return tuple([dict(zip(("kind", "start", "stop"), s)) for s in sorted(spans, key=order)] for spans in (base, base + more))

        return work

    span = "array<struct<kind: string, start: int, stop: int>>"
    return per_text(docs, f"base {span}, found {span}", factory, keep, text)


def _text_of(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _count_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and spans for each row of docs(doc_id, text).

    Null and empty texts have no spans; texts of any length are read whole, in time that grows as their length. Repeated rows
    stay, and each counts in the estimates. An empty table gives no rows. Other columns are not read.
    """
    out = find(docs)
    n = [_count_of(k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *n, F.sha2(_text_of(F.col("base")).cast("binary"), 256).alias("base_sha256"), _text_of(F.col("found")).alias("spans"))


MASKS = {k: f"<{k}>" for k in KINDS}


def masked(docs: DataFrame, accepted: frozenset[str] | None = None, text: str = "text") -> DataFrame:
    """docs with each found span of `text` replaced by its kind in angle brackets (of overlapping spans, their union by the first's). Null texts stay null."""
    accepted = classifier(docs) if accepted is None else accepted
    schema = docs.schema
    at = schema.names.index(text)

    def hide(t: str | None) -> str | None:
        if not t:
            return t
        spans = sorted((a, b, k) for k, a, b, is_base, v in candidates(t) if is_base or pattern(k, False, v) in accepted)
        out, end = [], 0
        for a, b, k in spans:
            if a >= end:
                out += [t[end:a], MASKS[k]]
            end = max(end, b)
        return "".join([*out, t[end:]]) if spans else t

    def run(batches):
        for batch in batches:
            for piece in slices(batch, text):
                yield {n: [hide(t) for t in c.to_pylist()] if i == at else c for i, (n, c) in enumerate(zip(schema.names, piece.columns))}

    return map_batches(docs, schema, run)


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """base_spans by the plain patterns, for tests: not linear on adversarial texts."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def base_sha256(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
