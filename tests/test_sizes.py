"""Operators on rows that come in another order each time, and queries where shuffles are dealt anew, as on larger tables."""

import random

import pytest

from lodestrand.operators import timeline as T
from lodestrand.plans import catalogue

from .conftest import TABLES
from .test_engine import FRAMES
from .test_queries import duck, plain  # noqa: F401

#: Small partitions of which some are joined, and no broadcasts: on small tables, plans as those of larger ones.
DEALT = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture(scope="module")
def dealt(spark):
    session = spark.newSession()
    for key, value in DEALT.items():
        session.conf.set(key, value)
    session.conf.set("spark.sql.session.timeZone", "UTC")
    return session


def reordered(df):
    """df, whose rows come in another order each time that they are read, as from a shuffle between machines."""

    def run(batches):
        for pdf in batches:
            yield pdf.sample(frac=1, random_state=random.SystemRandom().randrange(1 << 32))

    return df.coalesce(1).mapInPandas(run, df.schema)


def test_aligned_rows_in_any_order(spark):
    frames = spark.createDataFrame([(s, i, i * 0.5, i * 100 + s, 100, 22050, 44100) for s in range(5) for i in range(80)], FRAMES)
    rows = [(s, k, "HARD_CUT" if k % 2 else "CROSSFADE", k + 0.1, k + 0.1 if k % 2 else k + 2.1) for s in range(5) for k in range(30)]
    rows += rows[:3] + [(1, 99, "HARD_CUT", 3.0, None)]  # equal rows all stay, and one without an edge
    d = spark.createDataFrame(rows, "stream_id long, k long, kind string, incoming_start_s double, outgoing_end_s double")
    found = sorted((r.stream_id, r.k, r.split_kind, r.incoming_offset, r.outgoing_offset) for r in T.aligned(reordered(d), frames).collect() if r.k != 99)
    assert found == sorted((s, k, kind, 200 * k + s, 200 * k + s + (0 if kind == "HARD_CUT" else 400)) for s, k, kind, a, b in rows if k != 99)
    assert T.aligned(reordered(d), frames).where("k = 99").count() == 1


@pytest.mark.parametrize("name", ["q01_resolve_default", "q107_routing_trace", "q31_confidence", "q53_range_plan", "q57_symmetric_regions", "q59_fade_association", "q61_specialist_geometry", "q79_supported_exclusion", "q30_cluster", "q54_segment_tail", "q58_asymmetric_regions", "q60_route", "q78_insert_geometry", "q80_acoustic_island"])
def test_dealt(dealt, duck, name):  # noqa: F811
    found = duck.sql(catalogue.oracle_sql()[name])
    out = catalogue.queries()[name](dealt, TABLES)
    columns = sorted(out.columns)
    at = [found.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in out.collect()) == sorted([plain(r[i]) for i in at] for r in found.fetchall())
