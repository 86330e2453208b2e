"""Every registered query with SQL, on the smallest tables, against DuckDB."""

import math
import os

import pytest

import __spark_entry__ as entry
from skein.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    return "null" if v is None or isinstance(v, float) and math.isnan(v) else repr(float(v)) if not isinstance(v, (str, bool, int)) and hasattr(v, "__float__") else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    result = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 100
    assert set(entry.oracle_sql()) <= set(entry.queries())
