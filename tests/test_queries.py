"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from lodestrand.plans import catalogue

from .conftest import TABLES

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for n in NAMES:
        con.sql(f"create view {n} as select * from '{TABLES}/{n}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    return f"{float(value):.9g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    out = catalogue.queries()[name](spark, TABLES)
    rows = out.collect()
    if name not in catalogue.oracle_sql():
        assert len(out.columns) > 1
        return
    found = duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(out.columns)
    assert columns == sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    want = sorted([plain(r[i]) for i in at] for r in found.fetchall())
    assert sorted([plain(r[c]) for c in columns] for r in rows) == want
