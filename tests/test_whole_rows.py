"""Queries over all events and vectors, against NumPy on small tables."""

import datetime

import numpy as np
import pytest

from skein.operators import fit
from skein.plans import catalog

EVENTS, VECTORS = 2600, 270  # more than the prefixes that queries with SQL keep: 2,000, 500 and 250


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("whole")
    rng = np.random.default_rng(3)
    at = datetime.datetime(2000, 1, 1)
    users = rng.integers(0, 120, EVENTS)
    users[0] = 119
    value = 250 + 100 * np.sin(2 * np.pi * 7 * users / 120) + 60 * np.cos(2 * np.pi * 11 * users / 120) + 30 * np.sin(2 * np.pi * 23 * users / 120)
    events = [(k, at, int(users[k]), "x", float(value[k]), f'{{"k": {k * 3}}}') for k in range(EVENTS)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    vectors = rng.normal(size=(VECTORS, 64)).astype(np.float32)
    spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path), users, value / 100, vectors.astype(float)


def rows(spark, name, data, key, value):
    return {r[key]: r[value] for r in catalog.QUERIES[name](spark, data[0]).collect()}


def test_every_log_is_parsed(spark, data):
    assert rows(spark, "parse_last_json_all", data, "event_id", "k") == {k: 3 * k for k in range(EVENTS)}


def test_every_vector_has_heads(spark, data):
    v = data[3]
    linear = rows(spark, "on_linear_head_all", data, "vec_id", "head")
    assert np.allclose([linear[k] for k in range(VECTORS)], v @ [k % 5 - 2 for k in range(1, 65)], atol=1e-5) and len(linear) == VECTORS
    mlp = rows(spark, "on_mlp_head_all", data, "vec_id", "head")
    hidden = np.array([[(k + h) % 3 - 1 for k in range(1, 65)] for h in range(4)])
    want = v.sum(axis=1) + np.maximum(v @ hidden.T + 0.1 * np.arange(4), 0) @ (np.arange(4) - 1.0)
    assert np.allclose([mlp[k] for k in range(VECTORS)], want, atol=1e-5) and len(mlp) == VECTORS


def test_every_request_has_products(spark, data):
    _, users, _, v = data
    parts = v[users % VECTORS] * v[np.arange(EVENTS) % VECTORS]
    for name, column, want in (
        ("on_dot_predict_all", "score", np.clip(3 + parts.sum(axis=1), 0.5, 5)),
        ("on_pq_head_all", "head", 1.5 * parts[:, :2].sum(axis=1)),
        ("on_segment_dot_all", "score", 0.5 * parts[:, :16].sum(axis=1) + parts[:, 16:40].sum(axis=1) - 0.5 * parts[:, 40:].sum(axis=1)),
    ):
        got = rows(spark, name, data, "pos", column)
        assert len(got) == EVENTS and np.allclose([got[k] for k in range(EVENTS)], want, atol=1e-5)


def test_fourier_picks_its_frequencies(spark, data):
    got = {r["pos"]: r for r in catalog.QUERIES["fit_fourier_all"](spark, data[0]).collect()}
    assert len(got) == EVENTS and {got[0][f"u_f{k}"] for k in range(3)} == {7, 11, 23}
    at = [k for k in range(3) if got[0][f"u_f{k}"] == 11][0]
    assert np.allclose([got[k][f"u_cos{at}"] for k in range(EVENTS)], np.cos(2 * np.pi * 11 * data[1] / 120), atol=1e-5)


def test_fourier_is_fitted_at_the_frequencies_it_picks(spark, data):
    """The planted waves of the users, at frequencies that no plan names, are what the fit gives for every row."""
    _, users, rating, _ = data
    got = {r["pos"]: r for r in catalog.QUERIES["fit_fourier"](spark, data[0]).collect()}
    assert len(got) == EVENTS and {got[0][f"u_f{k}"] for k in range(3)} == {7, 11, 23}
    assert np.allclose([got[k]["fit"] for k in range(EVENTS)], rating - 2.5, atol=2e-3)


def test_fourier_finds_frequencies_among_many_ids(spark):
    """A frequency above half of 65,536, which is in one bin with its neighbours where ids are dealt into that many."""
    rows = spark.range(0, 200_000).selectExpr("id as u", "sin(2 * pi() * 70001 * id / 200000) + 0.4 * sin(2 * pi() * 12 * id / 200000) as e")
    assert fit.top_frequencies(fit.frequency_points(rows, "u", "e", 200_000), 2) == [70_001, 12]


def test_ridge_and_mixed_segments_of_all_rows(spark, data):
    _, users, rating, _ = data
    x = np.stack([np.ones(EVENTS), users / 150, np.arange(EVENTS) % 97 / 97], axis=1)
    want = np.linalg.solve(x.T @ x + 1e-4 * np.eye(3), x.T @ (rating - 2.5))
    got = rows(spark, "fit_ridge_all", data, "name", "value")
    assert np.allclose([got[k] for k in ("one", "x1", "x2")], want, atol=1e-6)
    found = catalog.QUERIES["fit_mixed_segments_all"](spark, data[0]).collect()
    cuts, values = ({s: [r[c] for r in found if r["side"] == s] for s in "ui"} for c in ("last", "value"))
    assert [len(cuts[s]) for s in "ui"] == [6, 4]
    # The items' segments, the last to be fitted, are the best for what the users' leave of all rows.
    left = rating - 2.5 - np.array(values["u"])[np.searchsorted(cuts["u"][:-1], users)]
    items = np.arange(EVENTS) % 97
    best = fit.segments([(float(i), float((items == i).sum()), left[items == i].mean()) for i in range(97)], 4)
    assert cuts["i"][:-1] == best[0] and np.allclose(values["i"], best[1], atol=1e-6)


def test_moment_score_of_every_row(spark, data):
    """The score's terms, one by one, in double precision."""
    _, users, rating, v = data
    items, e = np.arange(EVENTS) % 97, rating - 2.5
    side = {}
    for k, ids in (("u", users), ("i", items)):
        n = np.bincount(ids)
        n1 = np.maximum(n, 1)
        m, m2, m3 = (np.bincount(ids, weights=e**p) / n1 for p in (1, 2, 3))
        var = np.maximum(0, m2 - m * m)
        side[k] = {"n": n, "m": m, "v": var, "s": np.sqrt(var), "t": np.cbrt(m3 - 3 * m * m2 + 2 * m**3), "b": np.zeros(len(n))}
    for _ in range(4):
        side["u"]["b"] = 0.9 * np.bincount(users, weights=e - side["i"]["b"][items]) / (side["u"]["n"] + 24)
        side["i"]["b"] = 0.97 * np.bincount(items, weights=e - side["u"]["b"][users]) / (side["i"]["n"] + 4.5)
    U, I = ({k: x[ids] for k, x in side[s].items()} for s, ids in (("u", users), ("i", items)))
    for x in (U, I):
        x["l"], x["r"] = np.log1p(x["n"]), 1 / np.sqrt(x["n"] + 1)
    z = 2.8272202 + 0.8282023 * U["b"] + 0.0724656 * U["l"] + 0.3500099 * U["r"] - 0.1483637 * U["b"] ** 2 - 0.0694664 * abs(U["b"]) + 0.1128627 * U["m"] + 0.1603299 * U["v"] + 0.0333305 * U["m"] ** 2
    z += -0.1111785 * abs(U["m"]) - 0.1682727 * U["s"] - 0.0045373 * U["l"] ** 2 + 0.2081790 * U["b"] * U["m"] + 0.0260719 * U["m"] * U["v"] - 0.1280049 * U["m"] * U["r"] + 1.2661248 * U["b"] * U["r"]
    z += 0.2241798 * U["t"] - 0.0694539 * U["t"] ** 2 - 0.0854149 * U["t"] * U["m"] - 0.6939124 * U["t"] * U["r"] - 0.0405988 * U["t"] * U["l"] - 0.0462231 * (U["n"] <= 10) - 0.0106357 * (U["n"] > 100)
    z += 0.9197124 * I["b"] + 0.0934311 * I["l"] + 1.2312059 * I["r"] + 0.1891792 * I["b"] ** 2 - 0.1821118 * abs(I["b"]) + 0.0284896 * I["m"] + 0.2473170 * I["v"] - 0.0467627 * I["m"] ** 2
    z += 0.0903438 * abs(I["m"]) - 0.4104867 * I["s"] - 0.0004702 * I["l"] ** 2 - 0.1444060 * I["b"] * I["m"] + 0.0460050 * I["m"] * I["v"] + 0.3323592 * I["m"] * I["r"] - 1.2649461 * I["b"] * I["r"]
    z += -0.4601425 * I["t"] + 0.0403028 * I["t"] ** 2 - 0.0054509 * I["t"] * I["m"] + 0.6714242 * I["t"] * I["r"] + 0.0815008 * I["t"] * I["l"] - 0.1327588 * (I["n"] <= 3) - 0.0963986 * (I["n"] <= 10) + 0.0254704 * (I["n"] > 20)
    z += -0.0041441 * U["l"] * I["l"] - 0.0209655 * (U["l"] - I["l"]) - 1.6734969 * U["b"] * I["b"] + (-0.5421882 * U["m"] + 1.0260082 * U["b"]) * I["m"] + 0.7570391 * I["b"] * U["m"]
    z += 0.3827873 * I["s"] * U["s"] - 0.2084104 * U["v"] * I["v"] + 0.0061272 * U["t"] * I["t"] - 0.0862444 * U["t"] * I["m"] + 0.0641967 * I["t"] * U["m"] + 0.1059355 * U["t"] * I["s"] + 0.0212622 * I["t"] * U["s"]
    parts = v[users % VECTORS] * v[items % VECTORS]
    z += -0.00090916 + 0.6753163 * parts[:, :4].sum(axis=1) + 0.8459537 * parts[:, 4:8].sum(axis=1) + 0.8912842 * parts[:, 8:16].sum(axis=1) + 0.6222440 * parts[:, 16:32].sum(axis=1)
    got = rows(spark, "on_moment_calibrated_all", data, "pos", "score")
    assert len(got) == EVENTS and np.allclose([got[k] for k in range(EVENTS)], np.clip(z, 0.5, 5), atol=1e-5)


def test_joins_of_the_moment_score_move_no_vectors(spark):
    from dataclasses import replace

    from skein.operators import online
    from skein.plans.rating import MOMENTS

    rows = spark.range(40).selectExpr("id as pos", "id % 7 as u", "id % 5 as i", "cast(id % 3 as double) as rating")
    asked = rows.selectExpr("pos", "u", "i", "transform(sequence(1, 32), k -> cast(k as float)) as pv", "transform(sequence(1, 32), k -> cast(pos as float)) as qv")
    scored = online.moment_score(asked, rows, replace(MOMENTS, small=1)).select("pos", "score")
    todo, joins = [scored._jdf.queryExecution().optimizedPlan()], 0
    while todo:
        node = todo.pop()
        children = [node.children().apply(k) for k in range(node.children().size())]
        todo += children
        if node.nodeName() == "Join":
            joins += 1
            assert not any(name in child.output().mkString(" ") for child in children for name in ("pv#", "qv#"))
    assert joins >= 2 and scored.count() == 40
