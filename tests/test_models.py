"""Composed models, fitted designs and heads, gradient descent: against brute force and planted signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import compose, design, fit, models, online, ratings
from skein.operators.compose import Bias, Blend, Ensemble, Factors, Fitted, ItemMean, Neighbours
from skein.plans import inputs
from skein.stage import stage_bucketed


@pytest.fixture(scope="module")
def planted(spark):
    """Ratings of rank 2 with noise, of ids beyond 32 bits, in two parts."""
    rng = np.random.default_rng(2)
    p, q = rng.normal(0, 1, (60, 2)), rng.normal(0, 1, (40, 2))
    rows = [(5_000_000_000 + u, 7_000_000_000 + i, float(3 + p[u] @ q[i] + rng.normal(0, 0.1)), bool(rng.random() < 0.2)) for u in range(60) for i in range(40) if rng.random() < 0.7]
    both = spark.createDataFrame(rows, "u long, i long, rating double, held boolean").cache()
    return both.where("not held").drop("held"), both.where("held").drop("held")


def error(scored, held):
    return ratings.rmse(scored.join(held, ["u", "i"])).first()["rmse"]


def test_factors_learn_planted_ranks(planted):
    fitted, held = planted
    bias = models.bias_tables(fitted, 5.0, 2)
    base = error(models.score_bias(held, *bias).drop("rating"), held)
    assert base > 0.9
    assert error(models.als_scores(held, fitted, 2, 10, 0.02, bias=bias), held) < 0.5 * base
    for blocks in (1, 3):
        factors = models.sgd_factors(fitted, 2, 25, 0.05, 0.01, blocks)
        assert factors.groupBy("side").count().orderBy("side").collect() == [("item", 40), ("user", 60)]
        assert error(models.score_factors(held, factors, models.limits(fitted)), held) < 0.5 * base
    assert error(models.residual_factors(held, fitted, bias, rank=2, epochs=25, rate=0.05, reg=0.01, blocks=2), held) < 0.5 * base


def test_gradient_descent_in_one_block_is_sequential(spark):
    rows = [(1, 1, 5.0), (1, 2, 1.0), (2, 1, 3.0), (3, 2, 2.0)]
    got = models.sgd_factors(spark.createDataFrame(rows, "u long, i long, rating double"), 2, 1, 0.1, 0.02, 1)
    again = {(r["side"], r["id"]): r["bias"] for r in got.collect()}
    # Biases of one epoch, with the drawn factors so small that they hardly count.
    mean, bu, bi = 2.75, {1: 0.0, 2: 0.0, 3: 0.0}, {1: 0.0, 2: 0.0}
    for n in np.random.default_rng([1, 0, 0]).permutation(4):
        u, i, r = rows[n]
        off = r - mean - bu[u] - bi[i]
        bu[u] += 0.1 * (off - 0.02 * bu[u])
        bi[i] += 0.1 * (off - 0.02 * bi[i])
    assert all(abs(again["user", k] - v) < 0.02 for k, v in bu.items()) and all(abs(again["item", k] - v) < 0.02 for k, v in bi.items())


def test_equal_parts_are_fitted_once(planted):
    fitted, held = planted
    strong = Bias(2.0, 3)
    model = Ensemble(((0.5, Blend(strong, Factors(strong, 2, 3), 0.5)), (0.2, Neighbours(strong, 5)), (0.2, strong), (0.1, Blend(strong, ItemMean(), 0.2))), normalize=True)
    f = Fitted(fitted)
    scored = f.scores(model, held.unionByName(held))
    assert scored.count() == held.count() and f.fits == 3  # the bias, factors and neighbours
    with pytest.raises(ValueError):
        compose.make_model("nothing")
    assert {type(compose.make_model(n)) for n in ("baseline", "mf", "residual", "blend", "ensemble")} == {Bias, Factors, Blend, Ensemble}


def test_runs(spark, planted):
    fitted, held = planted
    found = compose.eval_run(fitted.unionByName(held), Bias(5.0, 2), 0.3).first()
    assert found["fitted"] + found["held"] == fitted.count() + held.count() and 0.9 < found["rmse"] < 2
    metrics = spark.createDataFrame([(1.0, 0.8), (1.0, 0.95), (1.0, float("nan")), (float("inf"), 0.1), (None, 0.1)], "a double, b double")
    assert [r["valid"] for r in compose.eval_valid(metrics, "a", "b", 0.1).collect()] == [True, False, False, False, False]


def test_tables_are_saved_and_loaded(spark, tmp_path):
    compose.save_tables({"users": spark.range(3), "items": spark.range(4)}, str(tmp_path))
    compose.save_tables({"users": spark.range(5)}, str(tmp_path))
    assert {n: t.count() for n, t in compose.load_tables(spark, str(tmp_path), ["users", "items"]).items()} == {"users": 5, "items": 4}
    with pytest.raises(ValueError):
        compose.save_tables({"../x": spark.range(1)}, str(tmp_path))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x, z = rng.normal(0, 1, (400, 5)), rng.normal(0, 1, (400, 4))
    w = rng.integers(1, 5, 400).astype(float)
    y = x @ [1.0, -2.0, 0.0, 0.5, 0.0] + 0.3 + rng.normal(0, 0.1, 400)
    pair = (x @ [0.5, 0, 1, 0, 0]) * (z @ [1, -1, 0, 0])
    relu = 2 * np.maximum(x @ [1, 1, 0, 0, 0], 0)
    frame = spark.createDataFrame([(k, x[k].tolist(), z[k].tolist(), float(w[k]), float(y[k]), float(pair[k]), float(relu[k])) for k in range(400)], "id long, x array<double>, z array<double>, w double, y double, pair double, relu double").cache()
    return frame, x, z, w, y, pair, relu


def test_sums_of_vectors(vectors):
    frame, x, z, w, y, _, _ = vectors
    gram, product, weight = design.vector_gram(frame, ["x", "z"], "y", "w")
    one = np.concatenate([np.ones((400, 1)), x, z], axis=1)
    assert np.allclose(gram, (one * w[:, None]).T @ one) and np.allclose(product, (one * w[:, None]).T @ y) and weight == w.sum()
    head = design.linear_head(frame, ["x"], "y", 0.0)
    assert np.allclose(head, np.linalg.lstsq(one[:, :6], y, rcond=None)[0])


def test_prior_by_vectors(spark, vectors):
    frame, x, _, w, y, _, _ = vectors
    rows = frame.select("id", F.explode(F.array_repeat("y", F.col("w").cast("int"))).alias("e"))
    found = design.p_prior(rows, frame.select("id", F.col("x").alias("v")), "id", "e", [2, 3], [1e-3, 10.0])
    assert found["strongest3"][1][:2] == [1, 0] and set(found["strongest3"][1]) == {0, 1, 3}
    for name in ("first2", "strongest3"):
        error, dims, intercept, c = found[name]
        assert abs(error - np.average((y - intercept - x[:, dims] @ c) ** 2, weights=w)) < 1e-9
        mean, centre = np.average(x[:, dims], axis=0, weights=w), np.average(y, weights=w)
        xc = (x[:, dims] - mean) * np.sqrt(w)[:, None]
        assert np.allclose(c, np.linalg.solve(xc.T @ xc + 1e-3 * np.eye(len(dims)), xc.T @ ((y - centre) * np.sqrt(w))))


def test_pair_and_mlp_heads_learn(vectors):
    frame, x, z, _, _, pair, relu = vectors
    a, b = design.pair_head(frame, "x", "z", "pair", 1, 1e-6, 6)
    assert np.abs((x @ a * (z @ b)).sum(axis=1) - pair).max() < 1e-3
    scored = frame.select(F.abs(design.pair_score("x", "z", a, b) - F.col("pair")).alias("off")).agg(F.max("off")).first()[0]
    assert scored < 1e-3
    w, hidden, bias, out, c = design.mlp_head(frame, ["x"], "relu", 6, 80, 0.05)
    made = x @ w + np.maximum(x @ hidden.T + bias, 0) @ out + c
    linear = np.concatenate([np.ones((400, 1)), x], axis=1)
    left = relu - linear @ np.linalg.lstsq(linear, relu, rcond=None)[0]
    assert np.sqrt(np.mean((made - relu) ** 2)) < 0.6 * left.std()


def test_factor_tables_learn(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(0, 1, 6), rng.normal(1, 0.5, 5)
    rows = [(u, float(a[u * 6 // 120] * b[u % 5] + rng.normal(0, 0.05))) for u in range(120) for _ in range(6)]
    frame = spark.createDataFrame(rows, "u long, e double")
    high, low = design.factor_tables(frame, "u", "e", 120, 6, 5, 1, 6, 0.01)
    prior = {r["u"]: r["prior"] for r in online.factor_user(frame.select("u").distinct(), high, low, 120, 6).collect()}
    assert max(abs(prior[u] - a[u * 6 // 120] * b[u % 5]) for u in range(120)) < 0.15


def test_ridge_grid(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (200, 3))
    y = x @ [1, 2, -1] + rng.normal(0, 0.3, 200)
    frame = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, e double")
    grid, solved = design.ridge_grid(frame, ["a", "b", "c"], "e", [0.0, 50.0], -1.5, 1.5)
    for r in grid.collect():
        c = np.linalg.solve(x.T @ x + r["rho"] * np.eye(3), x.T @ y)
        assert np.allclose(list(solved[r["rho"]].values()), c) and abs(r["rmse"] - np.sqrt(np.mean((np.clip(x @ c, -1.5, 1.5) - y) ** 2))) < 1e-9


def test_greedy_pairs_and_backfit_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 4, 600), rng.integers(0, 3, 600)
    e = rng.normal(0, 1, (4, 3))[a, b] + rng.normal(0, 0.2, 600)
    frame = spark.createDataFrame([(int(x), int(y), float(v)) for x, y, v in zip(a, b, e, strict=True)], "a int, b int, e double")
    left, want, budget = e.copy(), [], 20
    keys = {("a",): a, ("b",): b, ("a", "b"): a * 3 + b}
    while True:
        tried = []
        for names, key in keys.items():
            for lam in (5.0, 50.0):
                s, n = np.bincount(key, left, 12), np.bincount(key, minlength=12)
                v = s / (n + lam)
                if (n > 0).sum() <= budget and (names, lam) not in want and names not in [w[0] for w in want]:
                    tried.append(((2 * v * s - v * v * n).sum(), " x ".join(names), lam, names, v[key]))
        if not tried or max(tried[i][0] for i in range(len(tried))) < 1.0:
            break
        _, _, lam, names, fitted = max(tried, key=lambda t: t[:3])
        want.append((names, lam))
        budget -= len(set(keys[names]))
        left = left - fitted
    assert fit.greedy_tables(frame, ["a", "b", ("a", "b")], "e", [5.0, 50.0], 20, 1.0, 2) == want and want
    tables, errors = fit.backfit_until(frame, ["a", "b"], "e", 5.0, 2, 1e-6, 30)
    va, vb, seen = np.zeros(4), np.zeros(3), []
    for _ in errors:
        va = np.bincount(a, e - vb[b], 4) / (np.bincount(a, minlength=4) + 5)
        vb = np.bincount(b, e - va[a], 3) / (np.bincount(b, minlength=3) + 5)
        seen.append(np.sqrt(np.mean((e - va[a] - vb[b]) ** 2)))
    assert np.allclose(errors, seen) and len(tables) == 2


def test_refit_after_each_batch(spark, tmp_path):
    from skein.streaming.online import refit_per_batch

    for k in range(3):
        spark.createDataFrame([(k * 10 + n, float(k)) for n in range(10)], "pos long, rating double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("pos long, rating double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = refit_per_batch(rows, lambda h: h.agg(F.count("*").alias("n"), F.avg("rating").alias("m"))).orderBy("batch").collect()
    assert [(r["batch"], r["n"]) for r in got] == [(0, 10), (1, 20), (2, 30)] and got[2]["m"] == 1.0


def test_fourier_fit_finds_planted_frequencies(spark):
    rng = np.random.default_rng(9)
    rows = [(int(u), int(i), float(np.sin(2 * np.pi * 3 * u / 60) * np.cos(2 * np.pi * 5 * i / 40) + 0.5 * np.sin(2 * np.pi * 3 * u / 60) + 0.5 * np.cos(2 * np.pi * 5 * i / 40))) for u, i in zip(rng.integers(0, 60, 3000), rng.integers(0, 40, 3000), strict=True)]
    s = spark.createDataFrame(rows, "u long, i long, e double").cache()
    keys = [fit.top_frequencies(fit.frequency_points(s, k, "e", n), 1) for k, n in (("u", 60), ("i", 40))]
    assert keys == [[3], [5]]
    made = fit.product_basis(fit.fourier_basis(F.col("u"), 60.0, keys[0]), fit.fourier_basis(F.col("i"), 40.0, keys[1]))
    grid, _ = design.ridge_grid(s.select("e", F.lit(1.0).alias("one"), *[c.alias(k) for k, c in made.items()]), ["one", *made], "e", [1e-6], -9.0, 9.0)
    assert grid.first()["rmse"] < 1e-5


@pytest.mark.parametrize(("rows", "products", "absolute"), [(10**6, 10**6, True), (40, 30, True), (40, 30, False)])
def test_neighbours_equal_brute_force(spark, monkeypatch, rows, products, absolute):
    """Ties, a hot item, users without ratings, items without raters, nulls and repeated requests, in one block and in many."""
    monkeypatch.setattr(models, "KNN_ROWS", rows)
    monkeypatch.setattr(models, "PRODUCTS", products)
    rng = np.random.default_rng(8)
    e = {(u, 1): float(rng.normal()) for u in range(60)}
    e.update({(u, int(i)): float(rng.normal()) for u in range(50) for i in rng.integers(2, 30, 6)})
    e.update({(70, i): e.get((3, i), 0.0) for i in range(1, 30) if (3, i) in e})  # as like to all as 3 is
    e[80, 99] = 1.0  # shares no item with anyone
    asked = [(int(u), int(i)) for u, i in zip(rng.integers(0, 75, 150), rng.integers(1, 32, 150), strict=True)] + [(5, 1), (5, 1), (80, 1), (1, 99)]
    requests = spark.createDataFrame([*asked, (None, 1), (5, None)], "u long, i long")
    table = spark.createDataFrame([(u, i, x) for (u, i), x in e.items()] + [(None, 1, 1.0), (4, None, 1.0)], "u long, i long, e double")
    by = {}
    for (u, i), x in e.items():
        by.setdefault(u, {})[i] = x
    norm = {u: sum(x * x for x in row.values()) ** 0.5 for u, row in by.items()}
    want = set()
    for u, i in set(asked):
        near = []
        for v in by:
            shared = by.get(u, {}).keys() & by[v].keys()
            if v != u and i in by[v] and shared:
                s = round(sum(by[u][j] * by[v][j] for j in shared) / (norm[u] * norm[v] + 1e-6), 9)
                near.append((-abs(s) if absolute else -s, v, s))
        want |= {(u, i, v, s, round(by[v][i], 9)) for _, v, s in sorted(near)[:4]}
    got = models.neighbours(requests, table, 4, absolute).collect()
    assert len(got) == len(want) and {(r["u"], r["i"], r["v"], round(r["s"], 9), round(r["e"], 9)) for r in got} == want


def test_neighbours_of_nothing(spark):
    none = spark.createDataFrame([], "u long, i long, e double")
    some = spark.createDataFrame([(1, 1, 1.0), (2, 1, 1.0)], none.schema)
    assert not models.neighbours(none, some, 3).collect() and not models.neighbours(some, none, 3).collect()


def test_neighbours_send_ratings_to_blocks_of_their_items_only(spark, monkeypatch):
    """Users in groups that share no item: rows sent grow with the groups, not with their square."""
    sent = []

    def counted(groups):
        rows = [(100 * g + u, 100 * g + i, float(u + i + 1)) for g in range(groups) for u in range(8) for i in range(5)]
        table = spark.createDataFrame(rows, "u long, i long, e double")
        monkeypatch.setattr(models, "KNN_ROWS", 40)
        original = type(table).groupBy

        def watched(self, *keys):
            if keys == ("p", "q"):
                sent.append(self.count())
            return original(self, *keys)

        monkeypatch.setattr(type(table), "groupBy", watched)
        models.neighbours(table.select("u", "i"), table, 3).count()
        monkeypatch.setattr(type(table), "groupBy", original)

    for groups in (4, 16):
        counted(groups)
    assert sent[1] < 6 * sent[0]


def test_neighbours_of_mixed_users_send_a_rating_once_a_block(spark, monkeypatch):
    """Where every item has raters in all blocks, a rating passes by each block once and is held by one, in as many tasks as share the block; with many blocks, parts and batches the result is that of one block."""
    rng = np.random.default_rng(4)
    rows = {(int(u), int(i)): float(e) for u, i, e in zip(rng.integers(0, 300, 3000), rng.integers(0, 60, 3000), rng.normal(0, 1, 3000), strict=True)}
    table = spark.createDataFrame([(10**12 + u, -(10**12) + i, e) for (u, i), e in rows.items()], "u long, i long, e double")
    asked = table.where("pmod(u + i, 3) = 0").selectExpr("u", "i + 1 as i")
    whole = {tuple(r) for r in models.neighbours(asked, table, 5).collect()}
    sent, original = [], type(table).groupBy

    def watched(self, *keys):
        if keys == ("p", "q"):
            sent.append(self.where("kind != 1").agg(F.sum(F.octet_length("e"))).first()[0] / 8)
        return original(self, *keys)

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        for limit, passing, blocks, parts in ((len(rows) // 4 + 1, 10**6, 4, 1), (len(rows) // 70, len(rows) // 2, 71, 3)):
            monkeypatch.setattr(models, "KNN_ROWS", limit)
            monkeypatch.setattr(models, "KNN_PASSING", passing)
            monkeypatch.setattr(type(table), "groupBy", watched)
            near = models.neighbours(asked, table, 5)
            monkeypatch.setattr(type(table), "groupBy", original)
            got = {tuple(r) for r in near.collect()}
            assert {r[:3] for r in got} == {r[:3] for r in whole} and len(got) == len(whole)
            assert sent.pop() <= (blocks + parts) * len(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_gram_of_components_made_in_the_tasks(spark):
    """Products of two vectors' components, made from rows in a task, sum to what they sum to here."""
    rng = np.random.default_rng(12)
    p, q, y = rng.normal(0, 1, (50, 4)), rng.normal(0, 1, (50, 3)), rng.normal(0, 1, 50)
    frame = spark.createDataFrame([(a.tolist(), b.tolist(), float(c)) for a, b, c in zip(p, q, y, strict=True)], "p array<double>, q array<double>, y double")
    make = lambda a, b: (a[:, :, None] * b[:, None, :]).reshape(len(a), -1)
    gram, product, weight = design.vector_gram(frame, ["p", "q"], "y", made=make)
    x = np.concatenate([np.ones((50, 1)), make(p, q)], axis=1)
    assert weight == 50 and np.allclose(gram, x.T @ x) and np.allclose(product, x.T @ y)


def test_steps_made_at_once_equal_steps_in_turn():
    """Levels of ratings, those of crowded items and repeated pairs too, give what a plain sequential descent gives."""
    rng = np.random.default_rng(5)
    u, i, e = rng.integers(0, 50, 600), rng.integers(0, 7, 600), rng.normal(0, 1, 600)
    p, q, bu, bi = rng.normal(0, 0.1, (50, 3)), rng.normal(0, 0.1, (7, 3)), np.zeros(50), np.zeros(7)
    got = [a.copy() for a in (bu, p, bi, q)]
    models._descend(tuple(got[:2]), tuple(got[2:]), u, i, e, 0.05, 0.02)
    for a, b, r in zip(u, i, e, strict=True):
        x, y = p[a].copy(), q[b].copy()
        off = r - bu[a] - bi[b] - x @ y
        bu[a] += 0.05 * (off - 0.02 * bu[a])
        bi[b] += 0.05 * (off - 0.02 * bi[b])
        p[a] += 0.05 * (off * y - 0.02 * x)
        q[b] += 0.05 * (off * x - 0.02 * y)
    assert all(np.allclose(x, y, atol=1e-12) for x, y in zip(got, (bu, p, bi, q), strict=True))


def test_a_task_of_gradient_descent_holds_no_more_ids_than_asked(spark, monkeypatch):
    """Ids beyond what a pair of blocks may have are dealt over more blocks; ratings come in several batches."""
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(int(a), int(b), float(r)) for a, b, r in zip(rng.integers(0, 300, 3000), rng.integers(0, 200, 3000), rng.normal(3, 1, 3000))], "u long, i long, rating double")
    monkeypatch.setattr(models, "BLOCK_IDS", 100)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    staged, make = [], models.stage
    monkeypatch.setattr(models, "stage", lambda df: staged.append(make(df)) or staged[-1])
    try:
        factors = models.sgd_factors(rows, 2, 1, 0.05, 0.02, 1).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(staged) == 3 + 5 and len(factors) == len({(r["side"], r["id"]) for r in factors}) == 500
    assert all(r["bias"] for r in factors)


def test_levels_are_one_above_those_before(monkeypatch):
    """Those found at once and those walked one by one, of a crowded item."""
    rng = np.random.default_rng(7)
    u, i = rng.integers(0, 40, 500), np.where(rng.random(500) < 0.4, 3, rng.integers(0, 90, 500))
    want, users, items = [], {}, {}
    for a, b in zip(u.tolist(), i.tolist(), strict=True):
        want.append(max(users.get(a, -1), items.get(b, -1)) + 1)
        users[a] = items[b] = want[-1]
    for most in (0, 3, 64, 10**6):
        monkeypatch.setattr(models, "LEVELS", most)
        assert models._levels(u, i).tolist() == want


def test_gradient_descent_moves_pieces_and_meets_each_rating_once_an_epoch(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(10**11 + int(a), -(10**11) + int(b), float(r)) for a, b, r in zip(rng.integers(0, 300, 4000), rng.integers(0, 200, 4000), rng.normal(0, 1, 4000), strict=True)]
    table = spark.createDataFrame(rows, "u long, i long, rating double")
    moved, original = [], type(table).repartitionById
    monkeypatch.setattr(type(table), "repartitionById", lambda self, *a: moved.append(self.count()) or original(self, *a))
    monkeypatch.setattr(models, "SGD_PIECE", 300)
    monkeypatch.setattr(models, "ID_PIECE", 70)
    got = models.sgd_factors(table, 2, 2, 1e-7, 0.0, 2, mean=0.0).collect()
    assert len(moved) == 4 and max(moved) < 60
    again = models.sgd_factors(table.repartition(7, "i"), 2, 2, 1e-7, 0.0, 2, mean=0.0).collect()
    assert {tuple(map(str, r)) for r in got} == {tuple(map(str, r)) for r in again}  # however the rows lie
    # With so small a rate a bias is the rate times the sum of its ratings, twice.
    for side, k in (("user", 0), ("item", 1)):
        sums = {}
        for r in rows:
            sums[r[k]] = sums.get(r[k], 0.0) + r[2]
        found = {r["id"]: r["bias"] / 2e-7 for r in got if r["side"] == side}
        assert found.keys() == sums.keys() and all(abs(found[x] - y) < 0.5 + 0.1 * abs(y) for x, y in sums.items())


def test_factors_move_ratings_that_lie_by_user_once(spark):
    rows = spark.range(6000).selectExpr("id % 100 as u", "id div 100 as i", "cast((id * 7919) % 50 as double) as rating")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        laid = stage_bucketed(rows, "u")
        bias = models.bias_tables(laid, 5.0, 1)
        requests = spark.createDataFrame([(1, 1, 2.5), (1, 2, 3.5), (777, 3, 4.5)], "u long, i long, rating double")
        store = spark.sparkContext._jsc.sc().statusStore()
        tracker, seen = spark.sparkContext.statusTracker(), set()
        spark.sparkContext.setJobGroup("als", "als")
        got = {(r["u"], r["i"]): r for r in models.als_scores(requests, laid, 2, 2, bias=bias, keep=("rating",)).collect()}
        for job in tracker.getJobIdsForGroup("als"):
            seen |= set(tracker.getJobInfo(job).stageIds)
        known = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        moved = sum(s.shuffleWriteRecords() for s in (known.apply(n) for n in range(known.size())) if s.stageId() in seen)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {k: r["rating"] for k, r in got.items()} == {(1, 1): 2.5, (1, 2): 3.5, (777, 3): 4.5}
    base = {(r["u"], r["i"]): r["score"] for r in models.score_bias(requests, *bias).collect()}
    assert got[777, 3]["score"] == pytest.approx(base[777, 3])  # a user without factors keeps the bias score
    assert 6000 <= moved < 12_000


def test_ratings_by_user_are_the_same(spark):
    d = "/root/testdata/sf0.001"
    plain, by = inputs.ratings(spark, d), inputs.ratings(spark, d, "u")
    assert by.count() == plain.count() and plain.exceptAll(by).count() == 0
