"""Exact methods against brute force: segments by functional pruning, Kendall's tau by counted inversions."""

import time

import numpy as np
import pytest

from skein.operators import fit, online, ranking


def best_error(w, m, count):
    """Least error by trying every last cut, for each number of segments."""
    sw, s1, s2 = (np.concatenate([[0], np.cumsum(v)]) for v in (w, w * m, w * m * m))
    best = np.full(len(w) + 1, np.inf)
    best[0] = 0
    for _ in range(min(count, len(w))):
        now = np.full(len(w) + 1, np.inf)
        for b in range(1, len(w) + 1):
            now[b] = min(best[a] + s2[b] - s2[a] - (s1[b] - s1[a]) ** 2 / (sw[b] - sw[a]) for a in range(b))
        best = now
    return best[-1]


def error(points, cuts, values):
    return sum(w * (m - values[int(np.searchsorted(cuts, x))]) ** 2 for x, w, m in points)


@pytest.mark.parametrize("kind", ["noise", "ties", "steps"])
def test_segments_are_optimal(kind):
    rng = np.random.default_rng(len(kind))
    for _ in range(120):
        n, count = int(rng.integers(1, 90)), int(rng.integers(1, 8))
        m = {"noise": rng.normal(0, 1, n), "ties": rng.integers(0, 3, n).astype(float), "steps": np.repeat(rng.normal(0, 3, n // 10 + 1), 10)[:n] + rng.normal(0, 0.3, n)}[kind]
        points = list(zip(np.sort(rng.choice(10_000, n, replace=False)).astype(float), rng.integers(1, 9, n).astype(float), m, strict=True))
        cuts, values = fit.segments(points, count)
        assert len(values) == min(count, n) and cuts == sorted(cuts)
        assert error(points, cuts, values) == pytest.approx(best_error(np.array([p[1] for p in points]), m, count), abs=1e-7)


def test_segments_of_very_many_ids():
    rng = np.random.default_rng(3)
    n = 60_000
    w = rng.integers(1, 60, n).astype(float)
    steps = np.repeat([0.2, -0.3, 0.1, 0.4, -0.1, 0.0], n // 6)
    points = list(zip(np.arange(n, dtype=float) * 2, w, steps + rng.normal(0, 1, n) / np.sqrt(w), strict=True))
    began = time.process_time()
    cuts, values = fit.segments(points, 6)
    assert time.process_time() - began < 40
    assert np.allclose(cuts, np.arange(1, 6) * (n // 6 * 2), atol=400) and np.allclose(values, [0.2, -0.3, 0.1, 0.4, -0.1, 0.0], atol=0.02)
    assert fit.segments([(1.0, 2.0, 3.0)], 4) == ([], [3.0])


def test_inversions():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 333):
        for most in (1, 2, 9, 10_000):
            v = rng.integers(0, most, n)
            assert ranking.inversions(v) == sum(int((v[:k] > v[k]).sum()) for k in range(n))


def naive_tau(a, b):
    nodes = sorted(a.keys() & b.keys())
    pa, pb = ({k: p for p, (_, k) in enumerate(sorted((-r, k) for k, r in x.items()))} for x in (a, b))
    signs = [np.sign((pa[x] - pa[y]) * (pb[x] - pb[y])) for i, x in enumerate(nodes) for y in nodes[:i]]
    return sum(signs) / len(signs) if signs else None


@pytest.mark.parametrize("part", [3, 17, 4096])
def test_kendall_of_whole_rankings(spark, monkeypatch, part):
    monkeypatch.setattr(ranking, "LEAST_PART", part)
    rng = np.random.default_rng(part)
    a = {int(k): float(r) for k, r in zip(rng.permutation(150)[:120], rng.integers(0, 40, 120))}  # ties go by the node
    b = {k: a.get(k, 5.0) + float(rng.normal(0, 6)) for k in rng.permutation(150)[:130].tolist()}
    frames = [spark.createDataFrame(list(x.items()), "node long, rank double") for x in (a, b)]
    assert ranking.kendall_full(*frames).first()["tau"] == pytest.approx(naive_tau(a, b))
    assert ranking.kendall_full(frames[0], frames[0]).first()["tau"] == 1
    assert ranking.kendall_full(frames[0].limit(1), frames[0]).first()["tau"] is None
    assert ranking.kendall_full(frames[0].limit(0), frames[1]).first()["tau"] is None


@pytest.mark.parametrize("spread", [3, 1000, 10**12])
def test_segments_are_joined_by_buckets(spark, spread):
    """Thousands of segments, even and crowded together, keys on thresholds, beyond both ends and null; no nested loop in the plan."""
    rng = np.random.default_rng(spread)
    cuts = sorted({int(x) for x in np.concatenate([rng.integers(-spread, spread, 3000), spread * 5 + rng.integers(0, 50, 40)])})
    keys = [int(x) for x in rng.integers(-2 * spread, 12 * spread, 3000)] + cuts[:200] + [cuts[0] - 1, cuts[0], cuts[-1], cuts[-1] + 1, 10**15, -(10**15)]
    rows = spark.createDataFrame([(k, "x") for k in [*keys, None]], "u long, value2 string")
    segments = spark.createDataFrame([(t, float(k)) for k, t in enumerate(cuts)], "threshold long, value double")
    got = online.segment_join(rows, segments, "u", -1.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = sorted((k, float(np.searchsorted(cuts, k, side="left")) - 1) for k in keys)
    assert sorted((r["u"], r["value"]) for r in got.where("u is not null").collect()) == want
    assert [r["value"] for r in got.where("u is null").collect()] == [-1.0]
    assert online.segment_join(rows, segments.limit(0), "u", 2.0).where("value = 2").count() == len(keys) + 1
    assert online.segment_join(rows, segments.limit(1), "u", 2.0).count() == len(keys) + 1
