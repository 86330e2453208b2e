"""The classifiers against naive versions: trees by direct search and walk, the network step by step, its gradients by differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import labelled, quality, toxicity


def walk(trees, x):
    out = []
    for row in x:
        total = trees.base
        for t in range(len(trees.leaf)):
            at = 0
            while at < trees.feature.shape[1]:
                at = 2 * at + (2 if row[trees.feature[t, at]] > trees.threshold[t, at] else 1)
            total += trees.leaf[t, at - trees.feature.shape[1]]
        out.append(1 / (1 + np.exp(-total)))
    return np.array(out)


def naive_trees(x, y, weight):
    """(feature, threshold) of all inner nodes and leaf values, by trying every feature and edge on the node's rows."""
    share = (weight * y).sum() / weight.sum()
    total = np.full(len(y), np.log(share / (1 - share)))
    edges = [np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1]) for j in range(x.shape[1])]
    out = []
    for _ in range(quality.TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (p - y), weight * p * (1 - p)
        inner, leaves, rows = [], [], {0: np.arange(len(y))}
        for at in range(2**quality.DEPTH - 1):
            own, best = rows[at], (1e-9, 0, np.inf)
            score = lambda r: g[r].sum() ** 2 / (h[r].sum() + quality.L2)  # noqa: B023, E731
            for j in range(x.shape[1]):
                for edge in edges[j]:
                    right = x[own, j] > edge
                    if min(weight[own[right]].sum(), weight[own[~right]].sum()) >= quality.LEAST_ROWS:
                        gain = score(own[~right]) + score(own[right]) - score(own)
                        if gain > best[0] + 1e-9:
                            best = (gain, j, edge)
            inner.append(best[1:])
            right = x[own, best[1]] > best[2]
            rows[2 * at + 1], rows[2 * at + 2] = own[~right], own[right]
        for at in range(2**quality.DEPTH - 1, 2 ** (quality.DEPTH + 1) - 1):
            own = rows[at]
            leaves.append(-quality.RATE * g[own].sum() / (h[own].sum() + quality.L2))
            total[own] += leaves[-1]
        out.append((inner, leaves))
    return out


def test_trees_equal_naive_search(monkeypatch):
    for name, value in (("TREES", 4), ("DEPTH", 3), ("BINS", 12)):
        monkeypatch.setattr(quality, name, value)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 4))
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.5, 300)) > 0).astype(float)
    weight = rng.uniform(0.5, 2, 300)
    trees = quality.fit_trees(x, y, weight)
    for t, (inner, leaves) in enumerate(naive_trees(x, y, weight)):
        assert [(int(f), round(float(c), 9)) for f, c in zip(trees.feature[t], trees.threshold[t], strict=True)] == [(f, round(float(c), 9)) for f, c in inner]
        assert np.allclose(trees.leaf[t], leaves)
    assert np.allclose(trees.score(x), walk(trees, x))


def test_scores_of_documents_equal_naive_walk(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["one", "two", "THREE", "4", "five.\n", "x" * 30], int(n))) for n in rng.integers(0, 60, 120)] + [None, "", "\n" * 50, "é漢" * 4000]
    x = np.array([quality.statistics(t or "") for t in texts])
    y = np.array([k % 2 for k in range(len(texts))], float)
    trees = quality.fit_trees(x, y, np.ones(len(y)))
    rows = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(texts)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(rows, trees).collect()}
    assert np.allclose([got[k] for k in range(len(texts))], walk(trees, x))


def naive_logit(net, window, vectors):
    """One window's logit, a word and a direction at a time."""
    p, h = net.p, toxicity.HIDDEN
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    states = np.zeros((len(window), 2 * h))
    for d, order, side in (("f", range(len(window)), slice(0, h)), ("b", range(len(window) - 1, -1, -1), slice(h, 2 * h))):
        state = np.zeros(h)
        for t in order:
            x = vectors[window[t]] if window[t] >= 0 else np.zeros(toxicity.WIDTH)
            g, r = x @ p[f"in_{d}"] + p[f"bias_{d}"], state @ p[f"rec_{d}"]
            reset, keep = sigmoid(g[:h] + r[:h]), sigmoid(g[h : 2 * h] + r[h : 2 * h])
            state = (1 - keep) * np.tanh(g[2 * h :] + reset * r[2 * h :]) + keep * state
            states[t, side] = state
    score = np.array([np.tanh(s @ p["att"]) @ p["att_v"] if w >= 0 else -30.0 for s, w in zip(states, window, strict=True)])
    alpha = np.exp(score - score.max())
    return (alpha / alpha.sum()) @ states @ p["out"] + p["out_b"][0]


def network(rng):
    net = toxicity.Net.new(3)
    for k, v in net.p.items():
        net.p[k] = (v + rng.normal(0, 0.3, v.shape)).astype(np.float64)
    return net


def test_network_equals_naive_steps():
    rng = np.random.default_rng(5)
    net, words = network(rng), [f"word{k}é" for k in range(40)]
    features = toxicity.word_features(words)
    vectors = net.word_vectors(features)
    for k, w in enumerate(words):  # a word's vector: its own and the mean of its trigrams'
        row, tri, _ = toxicity.word_features([w])
        assert np.allclose(vectors[k], net.p["word"][row[0]] + net.p["char"][tri].mean(axis=0), atol=1e-5)
    windows, owner = toxicity.windows_of(rng.integers(0, 40, 150), [70, 0, 80])
    assert set(owner) == {0, 1, 2} and all((windows[owner == 1] < 0).ravel())
    got = net.forward(windows, net.gates(vectors))
    assert np.allclose(got, [naive_logit(net, w, vectors) for w in windows], atol=1e-4)


def test_windows_cover_every_word():
    ids = np.arange(1000)
    windows, owner = toxicity.windows_of(ids, [1, 31, 32, 33, 403, 500])
    starts = np.concatenate([[0], np.cumsum([1, 31, 32, 33, 403, 500])])
    for k in range(6):
        own = windows[owner == k]
        assert set(own[own >= 0]) == set(range(starts[k], starts[k + 1]))
        # Any WINDOW - STEP + 1 words in a row lie in one window.
        near = toxicity.WINDOW - toxicity.STEP + 1
        for a in range(starts[k], starts[k + 1] - near + 1):
            assert any({a, a + near - 1} <= set(w) for w in own)


def test_gradients_equal_differences():
    rng = np.random.default_rng(6)
    net, words = network(rng), [f"w{k}" for k in range(12)]
    features = toxicity.word_features(words)
    windows = rng.integers(-1, 12, (5, 9))
    windows[0, :] = -1
    y = np.array([0, 1, 1, 0, 1.0])

    def loss():
        z = net.forward(windows, net.gates(net.word_vectors(features))).astype(float)
        return np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z))))

    found = net.gradients(windows, features, y)
    for name, g in found.items():
        flat, at = net.p[name].reshape(-1), np.argsort(-np.abs(g.reshape(-1)))[:3]
        for k in at:
            before = flat[k]
            flat[k] = before + 1e-3
            up = loss()
            flat[k] = before - 1e-3
            down = loss()
            flat[k] = before
            assert abs((up - down) / 2e-3 - g.reshape(-1)[k]) < 2e-3 + 0.02 * abs(g.reshape(-1)[k]), (name, k)


def test_sample_is_settled_and_bounded(spark):
    docs = spark.createDataFrame([(k % 30, f"text {k}") for k in range(90)] + [(3, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(1, 0), (2, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    first, counts = labelled.labelled_sample(docs, labels, "toxic", F.lit(True), 8)
    again, _ = labelled.labelled_sample(docs.repartition(7), labels.repartition(3), "toxic", F.lit(True), 8)
    rows = sorted(first.collect())
    assert rows == sorted(again.collect()) and len({r["doc_id"] for r in rows}) == len(rows) <= 16 and counts == {0: 15, 1: 16}


@pytest.mark.parametrize(("module", "kind"), [(quality, "quality"), (toxicity, "toxic")])
def test_labels_of_one_class(spark, module, kind):
    docs = spark.createDataFrame([(k, f"text {k} " * (k % 7)) for k in range(40)] + [(None, None)], "doc_id long, text string")
    for value in (0, 1):
        labels = spark.createDataFrame([(k, value) for k in range(40)], f"doc_id long, {kind} int")
        scores = {r["score"] for r in module.score_documents(docs, module.train(docs, labels)).collect()}
        assert len(scores) == 1 and all((s >= 0.5) == (value == 1) and 0 <= s <= 1 for s in scores)
    assert module.train(docs.limit(0), labels.limit(0)) is not None


def test_one_unbroken_text_is_not_collected(spark):
    """Texts that are long without blanks aren't taken for training, and are scored whole."""
    docs = spark.createDataFrame([(k, "y" * 200_000) for k in range(4)] + [(k, f"fine words {k}") for k in range(4, 12)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 4)) for k in range(12)], "doc_id long, toxic int")
    net = toxicity.train(docs, labels, held_out=None)
    assert net.constant is not None and toxicity.score_documents(docs, net).count() == 12
