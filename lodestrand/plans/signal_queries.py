"""Queries over sample features and hybrid decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.operators import detect as D
from lodestrand.operators import hybrid as H
from lodestrand.operators import rank as R
from lodestrand.operators import spectral as S
from lodestrand.sources import bindings as B

from .detector_queries import SQL as DETECTOR_SQL
from .timeline_queries import FIXED_SQL, _fixed

RATE = 8000


def _pcm(spark, sf):
    """Texts' bytes as samples."""
    return B.read(spark, sf, "documents").select(F.col("doc_id").alias("stream_id"), F.encode("text", "UTF-8").alias("data"))


def _rounded(df):
    return df.withColumn("vec", F.transform("vec", lambda x: F.round(x, 6)))


def q72_block_vectors(spark, sf):
    return _rounded(S.block_vectors(_pcm(spark, sf), RATE, 0.1))


def q73_spectral_profiles(spark, sf):
    return _rounded(S.profiles(_pcm(spark, sf), RATE, 0.3))


def q74_temporal_variability(spark, sf):
    scaled = R.robust_scale(S.block_vectors(_pcm(spark, sf), RATE, 0.05))
    vectors = scaled.groupBy("stream_id", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "z"))), lambda s: s["z"]).alias("vec"))
    return R.contraction(R.bin_variability(vectors, 2))


def q75_band_edges(spark, sf):
    out = S.edge_evidence(S.band_features(_pcm(spark, sf), RATE), (0.1, 0.2))
    return out.select("stream_id", "idx", "horizon_s", F.round("energy", 6).alias("energy"), F.round("spectral", 6).alias("spectral"))


def q76_sample_novelty(spark, sf):
    out = S.novelties(_pcm(spark, sf), RATE, 0.1, 0.1)
    return out.select("stream_id", F.round("time_s", 6).alias("time_s"), F.round("novelty", 6).alias("novelty"))


def q77_hybrid_resolve(spark, sf):
    levels = B.levels(spark, sf)
    reference = _fixed(spark, sf).select("stream_id", "k", F.col("candidate_s").alias("reference_s"))
    return H.resolve(reference, D.quiet_basins(levels), D.energy_rises(levels))


QUERIES = {f.__name__: f for f in (q72_block_vectors, q73_spectral_profiles, q74_temporal_variability, q75_band_edges, q76_sample_novelty, q77_hybrid_resolve)}

BASINS_SQL = DETECTOR_SQL["q20_quiet_basin"].split("\n        select stream_id, l as left_idx")[0] + """, qb as (select stream_id, (l + r + 1) * 0.25::double as c, (r - l + 1) * 0.5::double as w, around / greatest(rms, 1e-9::double) as pr, overall / greatest(rms, 1e-9::double) as qu
  from (select *, row_number() over (partition by stream_id, l, r order by rms, idx) as n from e where (r - l + 1) * 0.5 <= 1.5) where n = 1)"""

SQL = {
    "q77_hybrid_resolve": BASINS_SQL
    + ", " + B.SQL["fr"] + ", " + FIXED_SQL
    + """, rx as (select *, avg(rms) over (partition by stream_id order by idx rows between 3 preceding and 1 preceding) as b3, avg(rms) over (partition by stream_id order by idx rows between current row and 2 following) as a3,
    avg(rms) over (partition by stream_id order by idx rows between current row and 9 following) as l3, median(rms) over (partition by stream_id) as m3, count(*) over (partition by stream_id) as n3 from lv),
  ri as (select stream_id, start_s as rise from rx where idx >= 3 and idx < n3 - 10 and a3 / greatest(b3, 1e-9) >= 2.5 and l3 / greatest(b3, 1e-9) >= 3 and a3 / greatest(m3, 1e-9) >= 2.5),
  pa as (select ca.stream_id, k, candidate_s as ref, c, candidate_s - c as lead, w, sqrt(qu) * sqrt(pr) * (1 + least(w, 0.75)) as sc from ca join qb on qb.stream_id = ca.stream_id and c < candidate_s),
  bb as (select stream_id, k, arg_min(c, row(-(sc / (1 + 0.18 * lead)), lead, c)) as basin, arg_min(c, row(-(sc * (1 + least(w, 0.75))), lead, c)) filter (where lead between 0.5 and 2.5) as inc from pa group by all),
  rr as (select ca.stream_id, k, max(rise) as rise from ca join ri on ri.stream_id = ca.stream_id and rise - candidate_s >= 1 group by all),
  j as (select ca.stream_id, k, candidate_s as reference_s, basin, inc, rise, coalesce(inc < rise, false) as x from ca left join bb using (stream_id, k) left join rr using (stream_id, k))
  select stream_id, k, reference_s, case when x then 'CROSSFADE' else 'HARD_CUT' end as kind, case when x then inc else basin end as incoming_start_s, case when x then rise else basin end as outgoing_end_s from j where x or basin is not null""",
}
