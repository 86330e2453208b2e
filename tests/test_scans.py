"""How many rows PageRank reads for its result, and that null, repeated and odd edges count as they did."""

from skein.operators import graph
from skein.operators.pagerank import pagerank


def rows_read(spark, name, run):
    """Rows that the tasks of ``run`` read from files."""
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        run()
        seen = {n for job in context.statusTracker().getJobIdsForGroup(name) for n in context.statusTracker().getJobInfo(job).stageIds}
        known = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(s.inputRecords() for s in (known.apply(n) for n in range(known.size())) if s.stageId() in seen)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def lying(spark, path, rows):
    """Edges as a table in a file, so that each scan of it counts."""
    spark.createDataFrame(rows, "src long, dst long").write.parquet(str(path))
    return spark.read.parquet(str(path))


def ring(nodes, each):
    """Every node has ``each`` edges out; none is a dead end."""
    return [(a, (a + k + 1) % nodes) for a in range(nodes) for k in range(each)]


#: Null at either end or both, a node that only leads to null, edges that come again, loops, a chain to a dead end and a tree that goes as a whole.
ODD = [(1, 2), (1, 2), (2, 3), (3, 1), (2, 2), (None, 1), (None, 1), (None, None), (3, None), (9, None), (8, 9), (3, 4), (4, 5), (5, 6), (20, 21), (20, 22), (None, 30), (31, None), (31, 6)]


def left(pairs):
    """Nodes that stay, null among them; no null meets another."""
    gone = set()
    while True:
        now = {x for e in pairs for x in e if x is not None and all(b in gone for a, b in pairs if a == x)}
        if now == gone:
            return {x for e in pairs for x in e} - gone
        gone = now


def deleted(pairs, rounds, distinct=False):
    """Ranks of what pruning leaves, 0 for the rest; null counts as a node, but neither gets rank nor keeps it after the first round."""
    alive = left(pairs)
    inner = [(a, b) for a, b in pairs if a is not None and b is not None and a in alive and b in alive]
    d = {x: sum(a == x for a, _ in inner) for x in alive}
    n, rank = len(alive), {x: 1 / len(alive) for x in alive}
    for _ in range(rounds):
        lost = sum(r for x, r in rank.items() if not d[x])
        new = {x: 0.15 / n + 0.85 * lost / n for x in alive if x is not None}
        for a, b in set(inner) if distinct else inner:
            new[b] += 0.85 * rank[a] / d[a]
        rank = new
    total = sum(rank.values())
    if abs(total - 1) > 1e-6:
        rank = {x: r / total for x, r in rank.items()}
    return {x: rank.get(x, 0.0) for e in pairs for x in e}


def near(got, want):
    return got.keys() == want.keys() and max((abs(got[x] - want[x]) for x in want), default=0) < 1e-12


def test_delete_keeps_odd_edges_as_they_were(spark):
    edges = spark.createDataFrame(ODD, "src long, dst long")
    found = [r[0] for r in graph.prune_dead_ends(edges).collect()]
    assert len(found) == len(set(found)) and set(found) == left(ODD) == {None, 1, 2, 3, 8, 9, 31}
    for distinct in (False, True):
        for pairs in (ODD, [e for e in ODD if None not in e]):
            rows = pagerank(spark.createDataFrame(pairs, "src long, dst long"), max_iter=4, dead_ends="delete", distinct=distinct)[0].collect()
            assert len(rows) == len({r["node"] for r in rows}) and near({r["node"]: r["rank"] for r in rows}, deleted(pairs, 4, distinct))
    whole = [e for e in ODD if None not in e]
    blocked = pagerank(spark.createDataFrame(whole, "src long, dst long"), max_iter=4, dead_ends="delete", blocks=2)[0].collect()
    assert near({r["node"]: r["rank"] for r in blocked}, deleted(whole, 4))
    some = pagerank(edges, spark.createDataFrame([(1,), (5,), (77,)], "node long"), max_iter=2, dead_ends="delete")[0].collect()
    assert near({r["node"]: r["rank"] for r in some}, {1: deleted(ODD, 2)[1], 5: 0.0, 77: 0.0})
    assert pagerank(edges.limit(0), max_iter=2, dead_ends="delete")[0].collect() == []


def test_delete_reads_edges_few_times(spark, tmp_path):
    """Distinct edges are written once; nodes and out-degrees, what is left, its degrees and its layout take a scan each, and a chain of dead ends one more to lay edges out by target."""
    rows = ring(300, 20)
    edges = lying(spark, tmp_path / "ring", rows + rows[:500])
    once = rows_read(spark, "delete", lambda: pagerank(edges, max_iter=1, dead_ends="delete")[0].collect())
    assert once < 8.5 * len(rows)  # of which two in the one round
    ended = lying(spark, tmp_path / "ended", rows + [(0, 900), (900, 901), (901, 902)])
    assert rows_read(spark, "ended", lambda: graph.prune_dead_ends(ended).collect()) < 5.5 * len(rows)
    assert rows_read(spark, "whole", lambda: graph.prune_dead_ends(edges).collect()) < 2.5 * len(rows)


def test_node_sums_take_one_pass(spark, tmp_path):
    from pyspark.sql import functions as F

    edges = lying(spark, tmp_path / "edges", ODD).withColumn("n", F.lit(2))
    got = []
    assert rows_read(spark, "sums", lambda: got.extend(graph.node_ids(edges, F.sum("n").alias("d"), F.count("n").alias("c")).collect())) == len(ODD)
    assert len(got) == len({x for e in ODD for x in e})
    for node, d, c in got:
        leaving = 0 if node is None else sum(a == node for a, _ in ODD)
        assert c == leaving and d == (2 * leaving or None)


def spread(pairs, rounds):
    """Ranks with dead ends shared out; null counts as a node and a dead end, and drops out after the first round unless an edge leads to it."""
    nodes = {x for e in pairs for x in e}
    d = {x: 0 if x is None else sum(a == x for a, _ in pairs) for x in nodes}
    n, rank = len(nodes), {x: 1 / len(nodes) for x in nodes}
    into = {b for a, b in pairs if a is not None}
    lost = sum(not d[x] for x in nodes) / n
    for _ in range(rounds):
        new = {x: 0.15 / n + 0.85 * lost / n for x in nodes if x is not None or x in into}
        for a, b in pairs:
            if a is not None:
                new[b] += 0.85 * rank[a] / d[a]
        rank = new
        lost = sum(r for x, r in rank.items() if x is not None and not d[x])
    return rank


def test_degrees_of_odd_edges_stay(spark):
    for pairs in (ODD, [e for e in ODD if e[1] is not None], [e for e in ODD if None not in e]):
        rows = pagerank(spark.createDataFrame(pairs, "src long, dst long"), max_iter=3)[0].collect()
        assert len(rows) == len({r["node"] for r in rows}) and near({r["node"]: r["rank"] for r in rows}, spread(pairs, 3))


def test_layout_reads_edges_twice(spark, tmp_path):
    """Beside the grouping of what comes in: one scan for nodes and degrees, one for the layout."""
    from skein.operators.pagerank import prepare

    rows = ring(300, 20)
    edges = lying(spark, tmp_path / "edges", rows)
    assert rows_read(spark, "layout", lambda: prepare(edges)) < 3.5 * len(rows)


def test_rounds_read_edges_once_each(spark, tmp_path):
    """The first round takes its ranks from the nodes, and no round looks for hubs among all nodes again."""
    from skein.operators.pagerank import prepare

    links = prepare(lying(spark, tmp_path / "ring", ring(300, 20)))
    assert links.hubs is None and rows_read(spark, "first", lambda: pagerank(links, max_iter=1)[0].write.format("noop").mode("overwrite").save()) <= 20 * 300 + 3 * 300
    hub = [(0, k) for k in range(1, 2000)] + [(k, 0) for k in range(1, 2000)]
    links = prepare(lying(spark, tmp_path / "hub", hub))
    assert links.hubs is not None and rows_read(spark, "hubs", lambda: links.hubs.collect()) == 1
    got = {r["node"]: r["rank"] for r in pagerank(links, max_iter=2)[0].collect()}
    # The hub gets all that the others have, and they share what it has: after two rounds each has its first share of what came back.
    first = 0.15 / 2000 + 0.85 * 1999 / 2000
    leaf = 0.15 / 2000 + 0.85 / 2000 / 1999
    assert near(got, dict.fromkeys(range(1, 2000), 0.15 / 2000 + 0.85 * first / 1999) | {0: 0.15 / 2000 + 0.85 * 1999 * leaf})


def test_history_begins_with_every_node(spark):
    rows = pagerank(spark.createDataFrame(ODD, "src long, dst long"), max_iter=1, history=True)[0].where("iteration = 0").collect()
    nodes = {x for e in ODD for x in e}
    assert len(rows) == len(nodes) and {r["node"]: r["rank"] for r in rows} == dict.fromkeys(nodes, 1 / len(nodes))
