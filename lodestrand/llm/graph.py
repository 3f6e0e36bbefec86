"""Connected components of an edge table, by alternating large stars and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, lookup, remove, written


#: Edges that a task writes at a round's end, about.
ROWS = 20_000


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node in edges(u, v), both long. Nothing is collected; each round is written to the shared folder, and goes once the next is there.

    A round sends the neighbours of each node to the least of them: first those above the node, then those below. Edges end
    as one star a component. The number of rounds grows as the logarithm of the longest path.
    """
    spark = edges.sparkSession
    pairs, place = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    size, state = pairs.count(), None
    while True:
        # a node with many neighbours is a hot key of both joins
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = lookup(both, least, "u", "n", 2 * size).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, between = written(large.coalesce(max(1, 2 * size // ROWS)))  # a plan holds one step
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = lookup(large, least, "u", "n", size).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        pairs, after = written(small.coalesce(max(1, size // ROWS)))  # edges only become fewer
        remove(spark, between)
        remove(spark, place)
        place = after
        found = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))).first()
        if found == state:
            break
        state, size = found, found[0]
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes = checkpoint(nodes.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component")))
    remove(spark, place)
    return nodes
