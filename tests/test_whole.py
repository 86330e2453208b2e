"""Queries over whole tables, against brute force on small tables."""

import datetime

import numpy as np
import pytest

from skein.plans import catalog

DATE = datetime.date(2000, 1, 1)


def lines(spark, path, orders):
    """``lineitem.parquet`` and ``orders.parquet`` of (customer, parts in turn, quantities or None) each order; the edges of the part graph."""
    rows = [(o, n, p, p % 3 + 1, float(q), 1.0, 0.0, 0.0, DATE) for o, (_, parts, qs) in enumerate(orders) for n, (p, q) in enumerate(zip(parts, qs or [1.0] * len(parts), strict=True))]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate date"
    spark.createDataFrame(rows, names).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(o, c) for o, (c, _, _) in enumerate(orders)], "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    return [(a, b) for _, parts, _ in orders for a, b in zip(parts, parts[1:])]


def fixpoint(edges):
    while True:
        kept = [(a, b) for a, b in edges if b in {s for s, _ in edges}]
        if len(kept) == len(edges):
            return {a for a, _ in kept}
        edges = kept


def test_prune_takes_a_long_chain_apart(spark, tmp_path):
    # A cycle of three, a chain of 12 that leads into it, and one of 12 that leads away to a dead end.
    edges = lines(spark, tmp_path, [(1, [1, 2, 3, 1], None), (1, [*range(10, 22), 1], None), (1, [2, *range(30, 42)], None)])
    got = catalog.QUERIES["graph_prune_deadends_all"](spark, str(tmp_path)).collect()
    assert {r["node"] for r in got if r["graph"] == "part"} == fixpoint(edges) == {1, 2, 3, *range(10, 22)}
    assert not [r for r in got if r["graph"] == "bipartite"]


def test_user_knn_scores_every_request(spark, tmp_path):
    rng = np.random.default_rng(5)
    rated = {(u, int(i)): float(rng.integers(1, 50)) for u in range(1, 31) for i in rng.choice(np.arange(1, 13), 7, replace=False)}
    lines(spark, tmp_path, [(u, [i for v, i in rated if v == u], [q for (v, _), q in rated.items() if v == u]) for u in range(1, 31)])
    is_held = {k: (k[0] * 7919 + k[1] * 104729) % 10 < 2 for k in rated}
    fit, held = ({k: r for k, r in rated.items() if is_held[k] == h} for h in (False, True))
    mean, low, high = np.mean(list(fit.values())), min(fit.values()), max(fit.values())
    shrunk = lambda rows: sum(rows) / (5 + len(rows))
    bu = {u: shrunk([r - mean for (v, _), r in fit.items() if v == u]) for u in range(1, 31)}
    bi = {i: shrunk([r - mean - bu[u] for (u, j), r in fit.items() if j == i]) for i in range(1, 13)}
    base = {k: np.clip(mean + bu[k[0]] + bi[k[1]], low, high) for k in rated}
    e = np.zeros((31, 13))
    for k, r in fit.items():
        e[k] = r - base[k]
    norm = np.sqrt((e**2).sum(axis=1))
    want = {}
    for u, i in held:
        others = [(e[u] @ e[v] / (norm[u] * norm[v] + 1e-6), v) for v in range(1, 31) if v != u and (v, i) in fit and any((u, j) in fit and (v, j) in fit for j in range(13))]
        best = sorted(others, key=lambda x: (-abs(x[0]), x[1]))[:10]
        want[u, i] = np.clip(base[u, i] + sum(s * e[v, i] for s, v in best) / (sum(abs(s) for s, _ in best) + 1), low, high)
    got = {(r["u"], r["i"]): r["score"] for r in catalog.QUERIES["user_knn_all"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and len({i for _, i in got}) > 5
    assert all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_components_join_through_every_edge(spark, tmp_path):
    # Hardly an edge has ends that are equal modulo 7.
    edges = lines(spark, tmp_path, [(1, [1, 2, 10, 3], None), (1, [20, 21], None), (1, [22, 21], None), (1, [30, 37, 31], None), (1, [40, 40], None)])
    root = {x: x for e in edges for x in e}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in catalog.QUERIES["graph_components_all"](spark, str(tmp_path)).collect()}
    assert got == {x: find(x) for x in root}


def test_delete_ranks_every_node(spark, tmp_path):
    # 9, 19 and 29 end in 9; a chain ends in a dead end; 50 has a self-loop, 1 to 9 is there twice.
    edges = lines(spark, tmp_path, [(1, [1, 9, 2, 19, 1, 29, 9, 29, 1, 9], None), (1, [2, 3, 4, 5], None), (1, [50, 50], None)])
    nodes = {x for e in edges for x in e}
    alive = sorted(fixpoint(edges))
    m = np.zeros((len(alive),) * 2)
    for a, b in edges:
        if a in alive and b in alive:
            m[alive.index(b), alive.index(a)] += 1
    m /= m.sum(axis=0)
    r = np.full(len(alive), 1 / len(alive))
    for _ in range(10):
        r = 0.15 / len(alive) + 0.85 * m @ r
    got = {x["node"]: x["rank"] for x in catalog.QUERIES["pr_delete_all"](spark, str(tmp_path)).collect()}
    assert got.keys() == nodes and {9, 19, 29} < set(alive) and got[5] == 0 < got[50]
    assert np.allclose([got[x] for x in alive], r, atol=1e-9)
