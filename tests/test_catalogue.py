"""Every query with SQL gives what DuckDB gives, on the smallest tables; without tables the tests are skipped."""

from __future__ import annotations

import os

import pytest

from dnsketch.plans import catalogue

DATA = os.environ.get("DNSKETCH_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 8) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    if name not in catalogue.SQL:
        assert got
        return
    rel = duck.sql(catalogue.SQL[name])
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    want = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=str)
    assert sorted(df.columns) == sorted(rel.columns) and got == want
