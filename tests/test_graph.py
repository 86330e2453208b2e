import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import graph, ranking
from skein.operators.components import connected_components
from skein.operators.pagerank import normalised, pagerank, prepare
from skein.sources import text


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def nodes(spark, n):
    return spark.range(n).withColumnRenamed("id", "node")


def ranks_of(df):
    return {r["node"]: r["rank"] for r in df.collect()}


# A graph small enough to rank by hand, and its ranks below.
HAND = [(0, 1), (1, 2), (2, 0), (3, 2)]


@pytest.mark.parametrize(("rounds", "want"), [(1, [0.234, 0.234, 0.404, 0.064, 0.064]), (2, [0.38428, 0.23978, 0.29418, 0.04088, 0.04088])])
def test_hand_computed(spark, rounds, want):
    got = ranks_of(pagerank(edges(spark, HAND), nodes(spark, 5), max_iter=rounds)[0])
    assert np.allclose([got[i] for i in range(5)], want, atol=1e-12)


def dense(pairs, n, rounds, beta=0.85):
    r, out = np.full(n, 1 / n), np.bincount([a for a, _ in pairs], minlength=n)
    for _ in range(rounds):
        new = np.full(n, (1 - beta) / n + beta * r[out == 0].sum() / n)
        for a, b in pairs:
            new[b] += beta * r[a] / out[a]
        r = new
    return r


def test_random_graph_blocks_and_dense(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in zip(rng.integers(0, 95, 500), rng.integers(0, 100, 500))] + [(3, 4), (3, 4)]
    want = dense(pairs, 100, 6)
    for blocks in (None, 1, 8):
        got = ranks_of(pagerank(edges(spark, pairs), nodes(spark, 100), max_iter=6, blocks=blocks)[0])
        assert np.allclose([got[i] for i in range(100)], want, atol=1e-12)


def test_dead_ends(spark):
    ranks, rounds, _ = pagerank(edges(spark, []), nodes(spark, 4), eps=1e-10)
    assert rounds == 1 and set(ranks_of(ranks).values()) == {0.25}
    ignored = pagerank(edges(spark, [(0, 1)]), max_iter=5, dead_ends="ignore")[0]
    assert sum(ranks_of(ignored).values()) < 0.7
    assert abs(sum(ranks_of(normalised(ignored)).values()) - 1) < 1e-12
    deleted = ranks_of(pagerank(edges(spark, [(0, 1), (1, 0), (1, 2)]), max_iter=20, dead_ends="delete")[0])
    assert deleted[2] == 0 and abs(deleted[0] - 0.5) < 1e-9


def test_trap_ranks_first(spark):
    top = ranking.top_k(pagerank(edges(spark, [(0, 1), (1, 2), (2, 3), (3, 2), (4, 2)]), eps=1e-10)[0], 2)
    assert {r["node"] for r in top.collect()} == {2, 3}


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        pagerank(edges(spark, HAND), beta=1.5)
    with pytest.raises(ValueError):
        pagerank(edges(spark, HAND), dead_ends="other")


def test_ids(spark):
    assert [tuple(r) for r in graph.id_space(edges(spark, [(10, 20), (20, 30)])).orderBy("idx").collect()] == [(10, 0), (20, 1), (30, 2)]
    assert graph.id_space(edges(spark, [(0, 1), (1, 3)])).count() == 4


@pytest.mark.parametrize("line", ["1 2 3", "a b", "", "-1 2", "1 3000000000"])
def test_bad_edge_lines(spark, line):
    with pytest.raises(Exception, match="not an edge"):
        text.parse_edges(spark.createDataFrame([(line,)], "value string")).collect()


def test_components_match_union_find(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_blocks_reject_bad_ids(spark):
    with pytest.raises(Exception, match="out of range"):
        graph.blocks(edges(spark, [(0, 9)]), 5, 2).collect()
    found = graph.blocks(edges(spark, HAND), 5, 8).orderBy("block").collect()
    assert [(r["first"], r["last"]) for r in found] == [(b * 5 // 8, (b + 1) * 5 // 8 - 1) for b in range(8)]
    assert [r["edges"] for r in found] == [sum(b * 5 // 8 <= dst < (b + 1) * 5 // 8 for _, dst in HAND) for b in range(8)]


def test_csr_check_finds_faults(spark):
    e = edges(spark, HAND)
    rows = graph.csr(e)
    good = graph.csr_check(e, rows).first()
    assert (good["edges"], good["in_rows"], good["wrong_rows"], good["missing"]) == (len(HAND), len(HAND), 0, 0)
    node = HAND[0][1]
    bad = graph.csr_check(e, rows.where(f"node <> {node}").withColumn("out_degree", F.col("out_degree") + F.when(F.col("node") == HAND[0][0], 1).otherwise(0)))
    assert bad.first()["missing"] == sum(dst == node for _, dst in HAND) and bad.first()["wrong_rows"] == (HAND[0][0] != node)


def test_hubs_are_dealt_over_buckets(spark, monkeypatch):
    """A source with most of all edges gives the same ranks as a brute-force iteration."""
    from skein.operators import pagerank as module

    rng = np.random.default_rng(3)
    pairs = [(0, int(k)) for k in range(1, 400)] + [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))]
    links = module.prepare(edges(spark, pairs))
    assert links.hubs is not None and links.hubs.first()["parts"] > 1
    nodes = sorted({n for p in pairs for n in p})
    at, out = {n: k for k, n in enumerate(nodes)}, np.zeros(len(nodes))
    m = np.zeros((len(nodes), len(nodes)))
    for a, b in pairs:
        out[at[a]] += 1
        m[at[b], at[a]] += 1
    m /= np.where(out, out, 1)
    rank = np.full(len(nodes), 1 / len(nodes))
    for _ in range(6):
        rank = 0.15 / len(nodes) + 0.85 * (m @ rank + rank[out == 0].sum() / len(nodes))
    got = {r["node"]: r["rank"] for r in module.pagerank(links, max_iter=6)[0].collect()}
    assert max(abs(got[n] - rank[at[n]]) for n in nodes) < 1e-12


def test_prune_to_empty(spark):
    assert graph.prune_dead_ends(edges(spark, [(0, 1), (1, 2)])).count() == 0


def test_pruning_meets_each_edge_once(spark, monkeypatch):
    """Long chains, a hub, a cycle, loops and repeated edges against a plain peel; only edges into nodes that just went are joined."""
    from skein.operators import graph

    rng = np.random.default_rng(4)
    pairs = [(k, k + 1) for k in range(30)] + [(200 + k, 30) for k in range(40)] + [(500, 501), (501, 500), (501, 7), (7, 7), (600, 500), (600, 601)] + [(int(a), int(b)) for a, b in rng.integers(700, 760, (70, 2))]
    pairs += pairs[:9]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    for rounds in (None, 0, 1, 3):
        left, done = {n for p in pairs for n in p}, 0
        while rounds is None or done < rounds:
            stay = {s for s, t in pairs if s in left and t in left}
            done += 1
            if stay == left:
                break
            left = stay
        assert {r[0] for r in graph.prune_dead_ends(edges, rounds).collect()} == left
    assert graph.prune_dead_ends(edges.limit(0)).collect() == []


def test_runs_in_the_same_rounds_equal_runs_by_themselves(spark, monkeypatch):
    """Several betas and limits take as many rounds as the longest, and each its own."""
    from skein.operators import pagerank as module

    rng = np.random.default_rng(5)
    links = module.prepare(edges(spark, [(int(a), int(b)) for a, b in rng.integers(0, 60, (150, 2))]))
    runs = [(0.85, 1e-3), (0.5, 1e-4), (0.85, 1e-5), (0.7, None)]
    alone = [module.pagerank(links, beta=beta, eps=eps, max_iter=30) for beta, eps in runs]
    staged, plain = [], module.stage
    monkeypatch.setattr(module, "stage", lambda df: staged.append(1) or plain(df))
    together = module.pageranks(links, runs, 30)
    assert len(staged) == max(rounds for _, rounds, _ in alone) == 30
    for (a, n, x), (b, m, y) in zip(alone, together, strict=True):
        a, b = ({r["node"]: r["rank"] for r in t.collect()} for t in (a, b))
        assert n == m and a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-14 and (x is y is None or abs(x - y) < 1e-12)


def test_blocks_send_sums_of_places_not_edges(spark):
    """Runs over packed blocks equal those over edges, in all rounds and with every treatment of dead ends; a block's edges bring one row of sums."""
    from skein.operators import pagerank as module

    rng = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (400, 2))] + [(7, 61), (7, 61), (7, 62)]
    links = module.prepare(edges(spark, pairs), blocks=3)
    sent = module._sent(links.degrees.withColumn("v0", F.col("n")), [0])
    assert links.numbers.agg(F.max("block")).first()[0] == 2 and links.links.sums(sent, "run").count() <= 9
    runs = [(0.85, 1e-3), (0.5, None), (0.85, 1e-5)]
    plain = module.pageranks(module.prepare(edges(spark, pairs)), runs, 12)
    for (a, n, x), (b, m, y) in zip(module.pageranks(links, runs, 12), plain, strict=True):
        a, b = ranks_of(a), ranks_of(b)
        assert n == m and a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-14 and (x is y is None or abs(x - y) < 1e-12)
    steps = [{(r["iteration"], r["node"]): r["rank"] for r in module.pagerank(edges(spark, pairs), max_iter=2, distinct=True, dead_ends="ignore", history=True, blocks=k)[0].collect()} for k in (None, 3)]
    assert steps[0].keys() == steps[1].keys() and max(abs(steps[0][k] - steps[1][k]) for k in steps[0]) < 1e-14


def test_pagerank_moves_no_edges_between_rounds(spark):
    """Few nodes with many edges each: a round shuffles ranks and sums, by tasks at most, but no edges."""
    rows = spark.range(40_000).selectExpr("id % 200 as src", "(id * 7919) % 199 as dst")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = prepare(rows)
        assert links.hubs is None
        spark.sparkContext.setJobGroup("rounds", "rounds")
        pagerank(links, max_iter=3)[0].collect()
        seen = {n for job in spark.sparkContext.statusTracker().getJobIdsForGroup("rounds") for n in spark.sparkContext.statusTracker().getJobInfo(job).stageIds}
        known = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        moved = sum(s.shuffleWriteRecords() for s in (known.apply(n) for n in range(known.size())) if s.stageId() in seen)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < moved < 10_000  # 3 rounds of 200 ranks and of 200 sums from each of 4 buckets
