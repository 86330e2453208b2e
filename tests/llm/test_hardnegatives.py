"""Hard negatives against scoring all pairs, and the brackets against scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import hardnegatives as hn

SCHEMA = "vec_id long, embedding array<long>, label int, anchor string"


def naive(rows, every, positives=5, negatives=5):
    ok = [(k, i, v, c) for k, (i, v, c, *_) in enumerate(rows) if c is not None and v is not None and all(x is not None and abs(x) <= 2**23 for x in v)]
    big = float("inf")
    out = []
    for k, i, v, c in ok:
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), big if j is None else j, d == c) for m, j, w, d in ok if m != k and len(w) == len(v))
        for p, pid, _ in [s for s in scored if s[2]][:positives]:
            fit = [s for s in scored if not s[2] and 80 * -p <= 100 * -s[0] <= 100 * -p]
            out += [(i, pid, r + 1, nid, -p, -s) for r, (s, nid, _) in enumerate(fit[:negatives])]
    return sorted(tuple(None if x == big else x for x in r) for r in out)


def mined(spark, rows, every, **more):
    got = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % every == 0, **more)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize(("seed", "n", "size", "spread"), [(0, 300, 6, 40), (1, 400, 3, 3), (2, 200, 16, 2**22)])
def test_against_all_pairs(spark, monkeypatch, seed, n, size, spread):
    monkeypatch.setattr(hn, "LEAST_BLOCK", 64)
    monkeypatch.setattr(hn, "TILE", 7)
    rng = np.random.default_rng(seed)
    centres = rng.integers(-spread, spread + 1, (6, size))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.integers(-max(1, spread // 6), max(2, spread // 6), size)
        rows.append((i, [int(x) for x in np.clip(v, -(2**23), 2**23)], int(rng.integers(0, 3)), "a"))
    rows += [(i, v, c, "b") for i, v, c, _ in rows[:20]] + [(10**6 + i, v, 1, "c") for i, v, _, _ in rows[:30]]  # repeated rows and copies
    assert mined(spark, rows, 10) == naive(rows, 10)


def test_special_rows(spark):
    rows = [(0, [3, 4], 1, "x"), (1, [3, 4], 1, None), (2, [3, 4], 2, "x"), (3, [3, 3], 2, "x"), (None, [3, 4], 2, "x"), (4, None, 2, "x"), (5, [3, None], 2, "x"), (6, [3, 4], None, "x"), (7, [2**24, 0], 2, "x")]
    rows += [(8, [3, 4, 5], 2, "x"), (10, [], 1, "x"), (11, [], 1, "x"), (12, [], 2, "x"), (20, [-9, 1], 7, "x"), (30, [1, 1], 9, "x"), (31, [-1, -1], 9, "x")]
    got = mined(spark, rows, 10)
    assert got == naive(rows, 10)
    assert [r[3] for r in got if r[0] == 0] == [2, None, 3] and [r[3] for r in got if r[0] == 10] == [12] and not [r for r in got if r[0] in (20, 30)]
    assert mined(spark, [], 10) == []
    assert mined(spark, rows, 10, positives=1, negatives=1) == naive(rows, 10, 1, 1)


def test_brackets_hold_and_save_work():
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, (20, 8))
    x = centres[rng.integers(0, 20, 4000)] + rng.integers(-4, 5, (4000, 8))
    most = float(np.sqrt((x**2).sum(axis=1).max()))
    table = hn.PivotTable(most, {8: hn.choose_pivots(x[:500].astype(float), most)})
    d, q = table.distances(hn.lengthen(x.astype(float), most), 8), table.distances(np.column_stack([x[:50].astype(float), np.zeros(50)]), 8)
    low, high = table.brackets((x[:50] ** 2).sum(axis=1)[:, None].astype(float), np.abs(q[:, None] - d).max(axis=2), (q[:, None] + d).min(axis=2))
    scores = x[:50] @ x.T
    assert (low <= scores).all() and (scores <= high).all()
    labels = rng.integers(0, 4, 4000)
    block = hn.Block(table, 8, [np.arange(4000), np.arange(4000), labels], x, d)
    whole = [np.full((50, 1), v) for v in (hn.NONE + 1, hn.LAST)]
    best, _, _ = block.search(x[:50], np.arange(50), labels[:50], True, *whole, 5)
    for k in range(50):
        own = np.flatnonzero((labels == labels[k]) & (np.arange(4000) != k))
        assert best[k, 0].tolist() == sorted(scores[k, own].tolist(), reverse=True)[:5]
    assert block.scored < 0.6 * 50 * 1000  # of some 1,000 rows of its label each


def test_query_against_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from skein.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute("create view embeddings as select * from read_parquet('/root/testdata/sf0.001/embeddings.parquet')")
    wanted = con.execute(ORACLES["op12_pivot_negatives"]).fetchall()
    got = QUERIES["op12_pivot_negatives"](spark, "/root/testdata/sf0.001").collect()
    assert wanted and sorted(map(tuple, got)) == sorted(wanted)
