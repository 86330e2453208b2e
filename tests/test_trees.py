"""Leaf-wise trees against a plain search over all leaves and cuts, and against depth-limited ones on later rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import fit, trees


def plain_tree(bins, y, leaves, rate, shrink, least):
    """Prediction of a tree grown by trying every leaf, feature and cut, the best first."""
    groups = [np.arange(len(y))]
    while len(groups) < leaves:
        best = (1e-12, None)
        for g, rows in enumerate(groups):
            whole = y[rows].sum() ** 2 / (len(rows) + shrink)
            for f in range(bins.shape[1]):
                for cut in np.unique(bins[rows, f]):
                    low = rows[bins[rows, f] <= cut]
                    high = rows[bins[rows, f] > cut]
                    if min(len(low), len(high)) >= least:
                        gain = y[low].sum() ** 2 / (len(low) + shrink) + y[high].sum() ** 2 / (len(high) + shrink) - whole
                        if gain > best[0] + 1e-9:
                            best = (gain, (g, low, high))
        if best[1] is None:
            break
        g, low, high = best[1]
        groups[g : g + 1] = [low, high]
    out = np.zeros(len(y))
    for rows in groups:
        out[rows] = rate * y[rows].sum() / (len(rows) + shrink)
    return out


@pytest.mark.parametrize("leaves", [2, 6, 15])
def test_trees_are_those_of_a_plain_search(spark, leaves):
    rng = np.random.default_rng(leaves)
    x = np.round(rng.normal(0, 1, (400, 3)), 2)
    x[rng.random((400, 3)) < 0.05] = np.nan
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) * np.nan_to_num(x[:, 1]) + rng.normal(0, 0.2, 400)
    rows = spark.createDataFrame([(k, *(None if np.isnan(v) else float(v) for v in r), float(t)) for k, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double").repartition(3)
    forest = trees.boost(rows, ["a", "b", "c"], "y", 3, leaves, 0.3, 1.0, 5, 16)
    bins, want = forest.bins(x), np.full(400, y.mean())
    for _ in range(3):
        want += plain_tree(bins, y - want, leaves, 0.3, 1.0, 5)
    got = {r["id"]: r["p"] for r in rows.select("id", forest.score().alias("p")).collect()}
    assert np.allclose([got[k] for k in range(400)], want)
    assert max(sum(f < 0 for f in t.feature) for t in forest.trees) <= leaves
    # Two trees, then one more from there, are the same three.
    two = trees.boost(rows, ["a", "b", "c"], "y", 2, leaves, 0.3, 1.0, 5, 16)
    warm = trees.boost(rows, ["a", "b", "c"], "y", 1, leaves, 0.3, 1.0, 5, 16, start=two)
    assert len(two.trees) == 2 and np.allclose(warm.predict(bins), want)


def test_error_on_later_rows_is_no_worse_than_by_depth(spark):
    rng = np.random.default_rng(9)
    x = rng.uniform(-1, 1, (3000, 3))
    y = np.sin(4 * x[:, 0]) * (x[:, 1] > 0) + (np.abs(x[:, 2]) < 0.1) * 2 + rng.normal(0, 0.1, 3000)
    rows = spark.createDataFrame([(k, *map(float, r), float(t)) for k, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double")
    early, late = rows.where("id < 2000"), rows.where("id >= 2000")
    ours = trees.boost(early, ["a", "b", "c"], "y", 20, 16, 0.3)
    other = fit.boosted(early, ["a", "b", "c"], "y", 20, 4)
    rmse = lambda scored, p: scored.agg(F.sqrt(F.avg((F.col(p) - F.col("y")) ** 2))).first()[0]
    mine = rmse(late.withColumn("p", ours.score()), "p")
    assert mine <= rmse(other.transform(late), "prediction") * 1.02 and mine < 0.5 * np.std(y[2000:])


def test_special_rows(spark):
    rows = spark.createDataFrame([(1.0, None, 2.0), (2.0, None, None), (float("nan"), None, 3.0)], "a double, b double, y double")
    forest = trees.boost(rows, ["a", "b"], "y", 2, least_rows=1)
    assert [t.feature[0] for t in forest.trees] == [0, 0] and rows.select(forest.score().alias("p")).count() == 3
    none = trees.boost(rows.limit(0), ["a"], "y")
    assert none.trees == [] and rows.select(none.score().alias("p")).first()["p"] == 0
