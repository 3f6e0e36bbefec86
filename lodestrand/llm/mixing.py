"""Mixing sources to target weights.

Every document gets a hash-random key. Keys are cut into ranges within each source; sums of sizes by (source, range)
give each range's offset, and a window within a range gives each document's. Both are prefix sums over small pieces, so
a hot source is spread over as many tasks as it has ranges. A source's target is cut into whole epochs and a rest; the
documents at the head of its key order, up to exactly the rest, are taken once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Rows that one range of keys holds, about.
RANGE_ROWS = 2_000
#: Ranges whose sizes are summed together.
SPAN = 4096
#: 15 hex digits of md5 are the key.
KEY_BITS = 60


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, rows, weight, target. One row a source, so windows without a partition stay as small as the list of sources.

    Sources by code point, null last, weigh `weights`, repeating. Shares that pass max_epochs times a source's size stop
    there, and the rest is shared again: sources are met in the order in which they stop, and the first that doesn't stop
    fixes the level of all after it.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")).cast("long")
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")).withColumn("weight", w)
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = (
        by.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("heavy", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    stops = F.col("weight") * F.col("left") > max_epochs * F.col("source_size") * F.col("heavy")
    first = F.min(F.when(~stops, F.struct((F.col("source_size") / F.col("weight")).alias("r"), F.col("left"), F.col("heavy")))).over(everything)
    level = by.withColumn("stops", stops).withColumn("level", first)
    return level.select(
        "source",
        "source_size",
        "rows",
        "weight",
        F.when(F.col("stops") | F.col("level").isNull(), (max_epochs * F.col("source_size")).cast("double"))
        .otherwise((F.col("weight") * F.col("level.left")).cast("double") / F.col("level.heavy"))
        .alias("target"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix-1", size=None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, source, source_size, target, key, taken for each row of docs(doc_id, text, source).

    Null or empty texts have size 0 and nothing is taken of them. A null source is a source of its own. Repeated rows each
    count; rows that agree in doc_id and key are ordered by size, so what they take together doesn't depend on the run.
    An empty table gives no rows. Reruns agree, as keys are hashes of seed and doc_id (without one, of the text).
    """
    size = size if size is not None else F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD))
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))  # rows without a doc_id spread by their texts
    key = F.conv(F.substring(F.md5(F.concat(name, F.lit(f"-{seed}"))), 1, KEY_BITS // 4), 16, 10).cast("long")
    sized = checkpoint(docs.select("doc_id", "source", size.cast("long").alias("size"), key.alias("key")))  # texts are read and counted once
    by = targets(sized, weights, max_epochs)
    # ranges double with the rows of a source: a power of two keeps a key's range a shift
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / range_rows))).cast("int")
    by = by.select("source", "source_size", "target", bits.alias("bits"))
    rows = sized.join(by, sized["source"].eqNullSafe(by["source"]), "left").drop(by["source"])
    rows = rows.withColumn("range", F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.floor(F.col("key") / F.pow(F.lit(2.0), KEY_BITS - F.col("bits"))).cast("long")))
    own = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    # prefix sums over ranges in two levels, so that a source's ranges aren't all in one task
    ranges = ranges.withColumn("span", F.floor(F.col("range") / SPAN))
    ahead = lambda *by: Window.partitionBy("source", *by).orderBy("range" if by else "span").rowsBetween(Window.unboundedPreceding, -1)
    spans = ranges.groupBy("source", "span").agg(F.sum("range_size").alias("span_size"))
    spans = spans.select(F.col("source").alias("s"), F.col("span").alias("p"), F.coalesce(F.sum("span_size").over(ahead()), F.lit(0)).alias("before"))
    inside = ranges.withColumn("in_span", F.coalesce(F.sum("range_size").over(ahead("span")), F.lit(0)))
    ranges = inside.join(spans, F.col("source").eqNullSafe(F.col("s")) & (F.col("span") == F.col("p"))).select(F.col("source").alias("s"), F.col("range").alias("r"), (F.col("before") + F.col("in_span")).alias("offset"))
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(own), F.lit(0))).join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")), "left")
    budget = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    once = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("offset") - F.col("inside")))
    rows = rows.withColumn("budget", budget).withColumn("epochs", epochs)
    return rows.select("doc_id", "size", "source", "source_size", "target", "key", (F.col("epochs") * F.col("size") + once).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix-1") -> DataFrame:
    """The mix itself, with the columns of docs: a document once for each whole time that it is taken, and the head of a text where a budget ends within it (n_chars follows the text)."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")

    mark = "__"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    own = mark.__add__  # names that no column of docs has

    def named(size: Column) -> Column:
        parts = [F.col("doc_id"), F.col("source"), size]
        return F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("")) for c in parts], *[c.isNull() for c in parts])

    nth = lambda order: F.row_number().over(Window.partitionBy(own("key")).orderBy(order))
    rows = docs.withColumn(own("size"), size).withColumn(own("key"), named(F.col(own("size")))).withColumn(own("nth"), nth(F.col("text")))
    taken = mix(docs, weights, max_epochs, seed).select(named(F.col("size")).alias(own("key")), "taken")
    taken = taken.withColumn(own("m"), nth(F.col("taken").desc())).where("taken > 0").select(F.col(own("key")).alias(own("k")), own("m"), F.col("taken").alias(own("taken")))
    rows = rows.join(taken, (F.col(own("key")) == F.col(own("k"))) & (F.col(own("nth")) == F.col(own("m"))))
    rows = rows.withColumn(own("whole"), F.floor(F.col(own("taken")) / F.col(own("size"))).cast("int")).withColumn(own("rest"), (F.col(own("taken")) % F.col(own("size"))).cast("int"))
    rows = rows.withColumn(own("copy"), F.explode(F.sequence(F.lit(1), F.col(own("whole")) + (F.col(own("rest")) > 0).cast("int"))))
    blank = WORD.replace("[^", "[").rstrip("+")
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"{blank}*{WORD}"), F.lit(0)), F.lit(1), F.col(own("rest"))), "")
    rows = rows.withColumn("text", F.when(F.col(own("copy")) > F.col(own("whole")), head).otherwise(F.col("text")))
    return (rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows).select(*docs.columns)


#: DuckDB's view of the query.
MIX_SQL = """
with sized as (
  select doc_id, source,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), md5(coalesce(text, ''))) || '-mix-1'), 1, 15) as bigint) as key
  from {docs}
), by_source as (
  select source, cast(sum(size) as bigint) as source_size,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
  from sized group by source
), level as (
  select source, source_size, weight,
         cast(sum(source_size) over () - 3 * coalesce(sum(source_size) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as bigint) as left_over,
         cast(sum(weight) over () - coalesce(sum(weight) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as bigint) as heavy
  from by_source
), stop as (
  select *, weight * left_over > 3 * source_size * heavy as stops from level
), free as (
  select left_over as l, heavy as h from stop where not stops order by source_size / weight limit 1
), target as (
  select source, source_size,
         case when stops or l is null then cast(3 * source_size as double) else cast(weight * l as double) / h end as target
  from stop left join free on true
), ahead as (
  select s.doc_id, s.size, t.source_size, t.target, s.source, s.key,
         cast(coalesce(sum(s.size) over (partition by s.source order by s.key, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0) as bigint) as before,
         cast(floor(t.target) as bigint) as budget
  from sized s join target t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target,
       cast(case when source_size = 0 then 0 else (budget // source_size) * size + least(size, greatest(0, budget - (budget // source_size) * source_size - before)) end as bigint) as taken
from ahead
"""
