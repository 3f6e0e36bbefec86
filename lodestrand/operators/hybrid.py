"""Which quiet basin and which rise a reference takes, and the decision that they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import timeline

BY = "stream_id"


def base_score() -> Column:
    """Quiet, prominent and, up to 0.75 s, wide basins score high."""
    return F.sqrt(F.greatest("quietness", F.lit(1e-9))) * F.sqrt(F.greatest("prominence", F.lit(1e-9))) * (1 + F.least("width_s", F.lit(0.75)))


def with_basins(references: DataFrame, basins: DataFrame, by: str = BY) -> DataFrame:
    """Each reference(k, reference_s) with the basins before it and their lead_s."""
    b = basins.withColumnRenamed(by, "__k")
    return references.join(b, (F.col(by) == F.col("__k")) & (F.col("center_s") < F.col("reference_s"))).withColumn("lead_s", F.col("reference_s") - F.col("center_s"))


def boundary_basin(pairs: DataFrame, keys: list[str], penalty: float = 0.18) -> DataFrame:
    """keys, basin_s: the best score, less by distance."""
    order = F.struct(-(base_score() / (1 + penalty * F.col("lead_s"))), "lead_s", "center_s")
    return pairs.groupBy(*keys).agg(F.min_by("center_s", order).alias("basin_s"))


def incoming_basin(pairs: DataFrame, keys: list[str], nearest: float = 0.5, farthest: float = 2.5) -> DataFrame:
    """keys, incoming_s: of basins with a fitting lead the best, width counting twice."""
    order = F.struct(-(base_score() * (1 + F.least("width_s", F.lit(0.75)))), "lead_s", "center_s")
    return pairs.where(F.col("lead_s").between(nearest, farthest)).groupBy(*keys).agg(F.min_by("center_s", order).alias("incoming_s"))


def crossfade_rise(references: DataFrame, rises: DataFrame, keys: list[str], delay: float = 1.0, by: str = BY) -> DataFrame:
    """keys, rise_s: the last rise at least `delay` after the reference."""
    last = rises.groupBy(by).agg(F.max("rise_s").alias("rise_s"))  # the stream's last is the last after any reference
    return references.select(*keys).join(last, by).where(F.col("rise_s") - F.col("reference_s") >= delay)


def resolve(references: DataFrame, basins: DataFrame, rises: DataFrame, by: str = BY) -> DataFrame:
    """kind, incoming_start_s, outgoing_end_s: a crossfade from a fitting basin to the rise, else a cut at the best basin; references with neither go."""
    keys = references.columns
    pairs = with_basins(references, basins, by)
    x = references.join(boundary_basin(pairs, keys), keys, "left").join(incoming_basin(pairs, keys), keys, "left").join(crossfade_rise(references, rises, keys, by=by), keys, "left")
    cross = F.coalesce(F.col("incoming_s") < F.col("rise_s"), F.lit(False))
    x = x.where(cross | F.col("basin_s").isNotNull())
    return x.select(*keys, F.when(cross, "CROSSFADE").otherwise("HARD_CUT").alias("kind"), F.when(cross, F.col("incoming_s")).otherwise(F.col("basin_s")).alias("incoming_start_s"), F.when(cross, F.col("rise_s")).otherwise(F.col("basin_s")).alias("outgoing_end_s"))
