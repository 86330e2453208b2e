"""Cross-fitted stacks: weights against plain least squares, and errors on ratings that took no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import compose, models
from skein.operators.compose import Bias, Factors, Fitted, ItemMean, Stack


def test_weights_are_least_squares_over_both_levels():
    rng = np.random.default_rng(0)
    x, fold = rng.normal(0, 1, (300, 3)), rng.integers(0, 3, 300)
    y = x @ [0.5, 0.3, 0.1] + 2 + rng.normal(0, 0.3, 300)
    z = np.column_stack([np.ones(300), x, y])
    grams = {f: z[fold == f].T @ z[fold == f] for f in range(3)}
    one = compose.stack_weights(grams, [(0, 1, 2)], 0.0)
    assert np.allclose(one, np.linalg.lstsq(z[:, :4], y, rcond=None)[0])
    groups, level = [(0, 1), (2,)], np.zeros((300, 2))
    for f in range(3):
        for g, parts in enumerate(groups):
            cols = [0, *(p + 1 for p in parts)]
            w = np.linalg.lstsq(z[fold != f][:, cols], y[fold != f], rcond=None)[0]
            level[fold == f, g] = z[fold == f][:, cols] @ w
    second = np.linalg.lstsq(np.column_stack([np.ones(300), level]), y, rcond=None)[0]
    want = np.zeros(4)
    want[0] = second[0]
    for g, parts in enumerate(groups):
        cols = [0, *(p + 1 for p in parts)]
        want[cols] += second[g + 1] * np.linalg.lstsq(z[:, cols], y, rcond=None)[0]
    assert np.allclose(compose.stack_weights(grams, groups, 0.0), want)


@pytest.fixture(scope="module")
def planted(spark):
    """Ratings of user and item effects, a rank-two pattern, and items whose users rate by the item alone; a fifth held out."""
    rng = np.random.default_rng(6)
    users, items = 60, 50
    bu, bi, p, q = rng.normal(0, 8, users), rng.normal(0, 10, items), rng.normal(0, 3.2, (users, 2)), rng.normal(0, 3.2, (items, 2))
    rows = [(u, i, float(np.clip(50 + bu[u] + bi[i] + p[u] @ q[i] + rng.normal(0, 4), 10, 100))) for u in range(users) for i in range(items) if rng.random() < 0.8]
    held = [r for k, r in enumerate(rows) if k % 5 == 0]
    schema = "u long, i long, rating double"
    return spark.createDataFrame([r for k, r in enumerate(rows) if k % 5], schema).repartition(2), spark.createDataFrame(held, schema).repartition(2)


def rmse(scored, held):
    return scored.join(held, ["u", "i"]).agg(F.sqrt(F.avg((F.col("score") - F.col("rating")) ** 2))).first()[0]


def test_stack_beats_its_parts_on_ratings_that_took_no_part(planted):
    fitted, held = planted
    parts = (Bias(2.0, 4), ItemMean(), Factors(Bias(2.0, 4), 2, 4))
    run = Fitted(fitted)
    errors = [rmse(run.scores(m, held), held) for m in parts]
    for stack in (Stack(parts, groups=((0, 1), (0, 2))), Stack(parts, calibration=("inv_uc", "pred_center2"))):
        before = run.fits
        assert rmse(run.scores(stack, held), held) < min(errors)
        model = run.stacked(stack)
        assert model is run.stacked(stack) and run.fits > before
    weights = dict(run.stacked(Stack(parts, groups=((0, 1), (0, 2)))).parts[2:3]).keys()
    assert max(weights) > 0.3  # the factors carry what the others lack


def test_out_of_fold_scores_know_nothing_of_their_fold(planted):
    fitted, _ = planted
    run = Fitted(fitted)
    got = run.out_of_fold((ItemMean(),), 3).collect()
    rows = [(r["u"], r["i"], r["rating"]) for r in fitted.collect()]
    assert sorted((r["u"], r["i"], r["rating"]) for r in got) == sorted(rows)
    for r in got[:60]:
        fold = (r["u"] * 31 + r["i"] * 17) % 3
        rest = [x for u, i, x in rows if i == r["i"] and (u * 31 + i * 17) % 3 != fold]
        everything = [x for u, i, x in rows if (u * 31 + i * 17) % 3 != fold]
        assert r["fold"] == fold and r["x0"] == pytest.approx(np.mean(rest or everything))


def test_no_ratings(spark):
    with pytest.raises(ValueError, match="no ratings"):
        Fitted(spark.createDataFrame([], "u long, i long, rating double")).stacked(Stack((ItemMean(),)))


def test_folds_are_scored_without_pairs_and_staged_one_by_one(planted, monkeypatch):
    staged = []
    monkeypatch.setattr(compose, "stage", lambda df, real=compose.stage: staged.append(df.columns) or real(df))
    fitted, _ = planted
    out = Fitted(fitted).out_of_fold((ItemMean(), Bias(5.0, 1)), 3)
    assert out.columns == ["u", "i", "rating", "fold", "x0", "x1"] and out.count() == fitted.count()
    assert staged == [["u", "i", "rating", "fold"]] + [out.columns] * 3


def test_last_users_biases_are_made_once(planted, monkeypatch):
    staged = []
    monkeypatch.setattr(models, "stage", lambda df, real=models.stage: staged.append(df.columns) or real(df))
    models.bias_tables(planted[0], 5.0, 2)
    assert staged == [["i", "bi"], ["u", "bu"], ["i", "bi"]]  # the items' of the last round read the users' table
