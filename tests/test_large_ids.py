"""Queries on ids beyond those of the test tables, against their SQL."""

import pytest

from skein.plans import catalog


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ids"))
    rows = [(n, u, float(n % 7) * 30) for n, u in enumerate([0, 3, 999, 1000, 1499, 2600, 89_999])]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["on_factor_user", "fit_fourier", "fit_fourier_basis"])
def test_users_beyond_a_thousand(spark, events, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{events}/events.parquet/*.parquet')")
    result = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in result.description]
    got = catalog.QUERIES[name](spark, events)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(result.fetchall())
