"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from clipweave.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equal_to_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = duck.execute(catalog.SQL[name])
    names = [x[0] for x in want.description]
    assert cols == sorted(names)
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in want.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in cols)) for r in got.collect()) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() >= 0
