"""URL filters: rules first, then a path-template tree for each host.

A url's path is cut into segments; runs of digits and hexadecimal names become wildcards at once. Then, level by level:

* Variable segments: one with many siblings, of which it isn't a main one, becomes a wildcard, which it shares only with
  siblings whose labels agree with its own (mostly blocked, mostly allowed, none). Where none is mostly allowed, those
  without labels share the wildcard of the blocked ones if as large a share of their urls ends there.
* Alike branches: siblings are put in order by their rate of blocked urls, or, where they have no labels, by the share of
  their urls that end there; neighbours that a two-proportion test can't tell apart, and whose labels agree, become one.

Labels come from the rules and from seed words in hosts and paths. A template is rejected if the smoothed share of blocked
urls in it reaches a threshold; each url without a label counts a part of one with the rate of all urls, so a few labels don't
speak for a template that is mostly unlabelled. Everything is counted over all urls by (host, prefix), so no host is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, lookup

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule): a rule is a host and the head of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words of a host or path (runs of letters) that label urls as blocked where no rule does.
SEEDS = ("casino", "poker", "bets", "betting", "pills", "viagra", "porn", "xxx", "ads", "adserver", "payday", "spam", "malware", "phishing", "warez")


@dataclass(frozen=True)
class Settings:
    """many: siblings beyond which segments become wildcards, unless they hold `main` of the parent's urls. strength: pseudo-counts of the rate of all urls. z: normal quantile up to which two rates are alike. least, purity: labelled urls and share of blocked ones that reject a template. loose: weight of a url without a label. depth: segments from here on are one, which is matched as a whole."""

    many: int = 32
    main: float = 0.05
    strength: float = 2.0
    z: float = 1.64
    least: int = 3
    purity: float = 0.8
    loose: float = 0.25
    depth: int = 64


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where there is no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # later ones wrap earlier ones
        own, slash, head = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + head)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def shape(path: Column, depth: int) -> Column:
    """Segments with hexadecimal names and runs of digits as wildcards."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    segments = F.transform(segments, lambda s: F.regexp_replace(F.regexp_replace(s, r"^(?=.*[0-9])[0-9a-fA-F]{8,}(?![^.])", "{h}"), r"[0-9]+", "{n}"))
    return F.when(F.size(segments) <= depth, segments).otherwise(F.concat(F.slice(segments, 1, depth - 1), F.array(F.array_join(F.slice(segments, depth, 1 << 30), "/"))))


SUMS = ("n", "labelled", "blocked", "ends")


def side() -> Column:
    """Mostly blocked (b), mostly allowed (a), or without labels (u)."""
    return F.when(F.col("labelled") == 0, "u").when(2 * F.col("blocked") > F.col("labelled"), "b").otherwise("a")


def different(hits: Column, of: Column, other_hits: Column, other_of: Column, z: float) -> Column:
    """A two-proportion test: whether two rates differ by more than z standard errors."""
    pooled = (hits + other_hits) / (of + other_of)
    return F.abs(hits / of - other_hits / other_of) > z * F.sqrt(pooled * (1 - pooled) * (1 / of + 1 / other_of))


def _moves(kids: DataFrame, keys: list[str], s: Settings) -> DataFrame:
    """keys, segment, now: what each child's segment becomes, of kids(keys, segment, SUMS)."""
    parents = checkpoint(kids.groupBy(*keys).agg(F.count(F.lit(1)).alias("kids"), F.sum("n").alias("all")))
    total = parents.agg(F.coalesce(F.sum("kids"), F.lit(0))).first()[0]
    wild = (F.col("kids") > s.many) & (F.col("n") < s.main * F.col("all"))
    held = parents.withColumn("of", F.col("kids"))
    kids = lookup(kids, held, keys, "of", total).withColumn("wide", F.when(wild, F.concat(F.lit("*"), side())).otherwise(F.col("segment")))
    branches = kids.groupBy(*keys, "wide").agg(*[F.sum(c).alias(c) for c in SUMS])
    # few branches of a parent are left: `many`, those above `main`, and three wildcards
    all_of = Window.partitionBy(*keys)
    pick = lambda c, w: F.max(F.when(F.col("wide") == w, F.col(c))).over(all_of)
    joint = different(pick("ends", "*b"), pick("n", "*b"), pick("ends", "*u"), pick("n", "*u"), s.z)
    joint = F.col("wide").isin("*b", "*u") & pick("n", "*a").isNull() & ~joint
    pools = branches.select(*keys, "wide", F.when(joint, "*").otherwise(F.col("wide")).alias("pool"))
    kids = kids.join(pools, [*keys, "wide"]).drop("wide").withColumnRenamed("pool", "wide")
    branches = kids.groupBy(*keys, "wide").agg(*[F.sum(c).alias(c) for c in SUMS])
    labelled = F.col("labelled") > 0
    hits, of = F.when(labelled, F.col("blocked")).otherwise(F.col("ends")), F.when(labelled, F.col("labelled")).otherwise(F.col("n"))
    branches = branches.withColumn("side", side()).withColumn("hits", hits).withColumn("of", of).withColumn("rate", F.col("hits") / F.col("of"))
    order = Window.partitionBy(*keys, "side").orderBy("rate", "wide")
    apart = F.coalesce(different(F.col("hits"), F.col("of"), F.lag("hits").over(order), F.lag("of").over(order), s.z), F.lit(True))
    branches = branches.withColumn("apart", apart).withColumn("group", F.sum(F.col("apart").cast("int")).over(order))
    own = Window.partitionBy(*keys, "side", "group")
    now = F.when(F.count(F.lit(1)).over(own) > 1, F.concat_ws("", F.lit("~"), F.col("side"), F.col("group").cast("string"))).otherwise(F.col("wide"))
    moves = kids.select(*keys, "segment", "wide").join(branches.select(*keys, "wide", now.alias("now")), [*keys, "wide"])
    return moves.select(*keys, "segment", "now")


def templates(urls: DataFrame, s: Settings = Settings()) -> DataFrame:
    """host, shape, template, labelled, blocked, purity, rejected, urls (how many there are) for each distinct host and shape of urls(host, shape, label: 1 blocked, 0 allowed, null)."""
    leaves = checkpoint(urls.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")))
    top = leaves.agg(F.sum("blocked"), F.sum("labelled"), F.max(F.size("shape")), F.count(F.lit(1))).first()
    rate = (top[0] or 0) / top[1] if top[1] else 0.0
    leaves, keys = leaves.withColumn("template", F.col("shape")), ["host", "prefix"]
    for level in range(top[2] or 0):
        prefix = F.slice("template", 1, level) if level else F.array().cast("array<string>")
        at = leaves.withColumn("prefix", prefix).withColumn("segment", F.get("template", F.lit(level)))
        ends = F.when(F.size("template") == level + 1, F.col("n")).otherwise(0)
        kids = at.where("segment is not null").withColumn("ends", ends).groupBy(*keys, "segment").agg(*[F.sum(c).alias(c) for c in SUMS])
        moves = _moves(checkpoint(kids), keys, s)
        leaves = at.join(moves, [*keys, "segment"], "left").withColumn(
            "template", F.when(F.col("now").isNull(), F.col("template")).otherwise(F.concat(F.col("prefix"), F.array("now"), F.slice("template", level + 2, 1 << 30)))
        )
        leaves = checkpoint(leaves.select("host", "shape", "n", "labelled", "blocked", "template"))  # a level's plan doesn't hold those above it
    by = leaves.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")], F.count(F.lit(1)).alias("shapes"))
    spare = s.strength + s.loose * (F.col("n") - F.col("labelled"))
    by = by.withColumn("purity", (F.col("blocked") + spare * rate) / (F.col("labelled") + spare)).drop("n")
    by = checkpoint(by.withColumn("rejected", (F.col("labelled") >= s.least) & (F.col("purity") >= s.purity)))
    return checkpoint(lookup(leaves.select("host", "shape", "template", F.col("n").alias("urls")), by, ["host", "template"], "shapes", top[3]))


def judge(pages: DataFrame, rules=RULES, seeds=SEEDS, s: Settings = Settings(), keep: tuple[str, ...] = ("page_id",), url: str = "url") -> DataFrame:
    """`keep`, host, path, rule, verdict, template, purity for each row of pages.

    Null urls, and those without ://, have empty hosts and paths, and are one leaf of the tree. Urls of any length are read
    whole. Repeated rows each stay and each count; branches with the same rate are ordered by name. An empty table gives no
    rows. Other columns are not read.
    """
    names = {c: f"__{i}" for i, c in enumerate(keep)}
    host, path = parts(F.col(url))
    rows = pages.select(*[F.col(c).alias(names[c]) for c in keep], host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    words = F.split(F.translate(F.concat_ws("/", "host", "path"), UPPER, LOWER), "[^a-z]+")
    seeded = F.arrays_overlap(words, F.array(*map(F.lit, seeds)))
    label = F.when(verdict == "block", 1).when(verdict == "allow", 0).when(seeded, 1)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), label.alias("label"), shape(F.col("path"), s.depth).alias("shape"))
    tree = templates(rows.select("host", "shape", "label"), s).select("host", "shape", "template", "purity", "rejected", "urls")
    total = tree.agg(F.coalesce(F.sum("urls"), F.lit(0))).first()[0]
    rows = lookup(rows, tree, ["host", "shape"], "urls", total)
    verdict = F.coalesce("ruled", F.when(F.col("rejected"), "block").otherwise("allow"))
    return rows.select(*[F.col(names[c]).alias(c) for c in keep], "host", "path", "rule", verdict.alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")
