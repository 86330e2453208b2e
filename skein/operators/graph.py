"""Graphs as edge tables ``(src, dst)``: identifiers, layout, profile, pruning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators.components import connected_components
from skein.stage import discard, scratch, stage

#: Ids from 0 are kept as indices when at least this share of 0..max occurs.
DENSE_SHARE = 0.5


def node_ids(edges: DataFrame, *sums: Column) -> DataFrame:
    """``node`` of both ends of all edges. ``sums`` of the edges' other columns go over the edges that leave a node, of which null has none, as in a join; they are made in the same pass."""
    if not sums:
        return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    others = [c for c in edges.columns if c not in ("src", "dst")]
    leaves = F.struct(F.col("src").alias("node"), *[F.when(F.col("src").isNotNull(), F.col(c)).alias(c) for c in others])
    meets = F.struct(F.col("dst").alias("node"), *[F.lit(None).alias(c) for c in others])
    return edges.select(F.inline(F.array(leaves, meets))).groupBy("node").agg(*sums)


def id_space(edges: DataFrame) -> DataFrame:
    """``node_id, idx``: the ids themselves with the gaps filled if they are dense from 0, else consecutive ranks."""
    ids = stage(node_ids(edges))
    low, high, n = ids.agg(F.min("node"), F.max("node"), F.count("*")).first()
    if low == 0 and n / (high + 1) >= DENSE_SHARE:
        return edges.sparkSession.range(high + 1).select(F.col("id").alias("node_id"), F.col("id").alias("idx"))
    return ranked(ids.withColumnRenamed("node", "node_id"), "node_id", "idx")


def ranked(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with the rank from 0 of a unique ``key``, without one task for all: ranks within ranges, shifted by the ranges' counts."""
    ranges = stage(rows.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))  # a row a partition
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return ranges.withColumn("_rank", inside).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_rank") - 1).drop("_part", "_rank", "_start")


def remap(edges: DataFrame, ids: DataFrame) -> DataFrame:
    s = ids.select(F.col("node_id").alias("src"), F.col("idx").alias("s"))
    t = ids.select(F.col("node_id").alias("dst"), F.col("idx").alias("t"))
    return edges.join(s, "src").join(t, "dst").select(F.col("s").alias("src"), F.col("t").alias("dst"))


def degrees(edges: DataFrame) -> DataFrame:
    """``node, out_degree, in_degree, degree``, multiple edges counted; one pass, aggregated before the shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    out = F.sum("o").alias("out_degree")
    return ends.groupBy("node").agg(out, F.sum(1 - F.col("o")).alias("in_degree"), F.count("*").alias("degree"))


def csr(edges: DataFrame) -> DataFrame:
    """``node, row_start, out_degree, adjacency`` (ascending): compressed sparse rows, a row for each node."""
    rows = edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("adjacency")).withColumnRenamed("src", "node")
    rows = node_ids(edges).join(rows, "node", "left").withColumn("adjacency", F.coalesce("adjacency", F.array().cast("array<bigint>")))
    rows = stage(rows.withColumn("out_degree", F.size("adjacency").cast("long")).repartitionByRange("node").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(F.sum("out_degree").alias("d")).select("_part", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("_start"))
    inside = F.sum("out_degree").over(Window.partitionBy("_part").orderBy("node")) - F.col("out_degree")
    return rows.withColumn("_in", inside).join(F.broadcast(starts), "_part").select("node", (F.col("_start") + F.col("_in")).alias("row_start"), "out_degree", "adjacency")


def csr_edges(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("node").alias("src"), F.explode("adjacency").alias("dst"))


def csr_check(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: edges, edges in the rows, nodes of edges without a row."""
    known = rows.select(F.col("node").alias("dst"))
    missing = edges.join(known, "dst", "left_anti").agg(F.count("*").alias("missing"))
    counts = rows.agg(F.sum("out_degree").alias("in_rows"), F.sum(F.when(F.size("adjacency") != F.col("out_degree"), 1).otherwise(0)).alias("wrong_rows"))
    return edges.agg(F.count("*").alias("edges")).crossJoin(counts).crossJoin(missing)  # one row each


def block_of(dst: Column, nodes: int, blocks: int) -> Column:
    """Block b of K holds the ids from floor(b N / K) up to floor((b + 1) N / K)."""
    return F.floor(((dst + 1) * blocks - 1) / F.lit(nodes)).cast("long")


def blocks(edges: DataFrame, nodes: int, count: int) -> DataFrame:
    """``block, first, last, edges`` for each destination block, empty ones included; ids outside 0..nodes-1 are an error."""
    bad = (F.col("dst") < 0) | (F.col("dst") >= nodes) | (F.col("src") < 0) | (F.col("src") >= nodes)
    checked = edges.withColumn("dst", F.when(bad, F.raise_error(F.concat(F.lit("node out of range in edge "), "src", F.lit(" "), "dst"))).otherwise(F.col("dst")))
    found = checked.groupBy(block_of(F.col("dst"), nodes, count).alias("block")).agg(F.count("*").alias("edges"))
    every = edges.sparkSession.range(count).select(F.col("id").alias("block"))
    bounds = every.select("block", F.expr(f"block * {nodes} div {count}").alias("first"), F.expr(f"(block + 1) * {nodes} div {count} - 1").alias("last"))
    return bounds.join(found, "block", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


def degree_histogram(edges: DataFrame) -> DataFrame:
    """``degree, out_nodes, in_nodes`` for each degree up to the largest."""
    d = stage(degrees(edges))
    both = d.select(F.explode(F.array(F.struct(F.col("out_degree").alias("degree"), F.lit(1).alias("o")), F.struct(F.col("in_degree").alias("degree"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    counts = both.groupBy("degree").agg(F.sum("o").alias("out_nodes"), F.sum(1 - F.col("o")).alias("in_nodes"))
    every = d.agg(F.max(F.greatest("out_degree", "in_degree")).alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("degree"))
    return every.join(counts, "degree", "left").select("degree", F.coalesce("out_nodes", F.lit(0)).alias("out_nodes"), F.coalesce("in_nodes", F.lit(0)).alias("in_nodes"))


def profile(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, average and greatest degrees, dead ends, self-loops, repeated edges."""
    d = degrees(edges).agg(
        F.count("*").alias("nodes"),
        F.avg("out_degree").alias("avg_out"),
        F.max("out_degree").alias("max_out"),
        F.max("in_degree").alias("max_in"),
        F.count_if(F.col("out_degree") == 0).alias("dead_ends"),
    )
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    e = pairs.agg(F.sum("n").alias("edges"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("n")).otherwise(0)).alias("self_loops"), (F.sum("n") - F.count("*")).alias("repeated"))
    return d.crossJoin(e)  # one row each


def isolated(edges: DataFrame, nodes: int) -> DataFrame:
    """Ids of 0..nodes-1 without an edge."""
    return edges.sparkSession.range(nodes).select(F.col("id").alias("node")).join(node_ids(edges), "node", "left_anti")


def component_sizes(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``component, nodes`` of the weakly connected components; ``nodes`` adds isolated ones."""
    found = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    if nodes is not None:
        found = nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return found.groupBy("component").agg(F.count("*").alias("nodes"))


#: Parts by hash that edges are stored in for pruning, and tables of one kind that are kept before they become one.
PARTS, TABLES = 16, 8


def _part(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(PARTS)).cast("int")


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _by_target(edges: DataFrame, known: DataFrame) -> DataFrame:
    """``src, dst, degree, part`` of the edges, in folders by the part of their target."""
    path = scratch(edges.sparkSession, "parted")
    into = edges.select("src", "dst").join(known.where("degree > 0").withColumnRenamed("node", "src"), "src").withColumn("part", _part("dst"))
    into.repartition("part", F.pmod(F.xxhash64("src"), F.lit(PARTS))).write.partitionBy("part").parquet(path)  # a hub's edges lie in several files
    return edges.sparkSession.read.schema(into.schema).parquet(path)


def prune_dead_ends(edges: DataFrame, rounds: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """Nodes left after repeatedly taking out those without an edge to a remaining node; ``rounds`` limits the repetition.

    A round joins only edges into nodes that just went: they count down their sources' out-degrees, and sources that reach none go next. So each edge is joined once, however long the chains are.
    Edges lie in parts by their target's hash, of which a round reads those that it has nodes in; a graph without dead ends isn't laid out at all.
    ``known`` has all nodes with their out-degrees (``node, degree``), staged, where edges are staged too and none comes twice.
    """
    if known is None:
        edges = stage(edges.select("src", "dst").distinct())
        known = stage(node_ids(edges.withColumn("n", F.lit(1)), F.count("n").alias("degree")))
    front = stage(known.where("degree = 0 and node is not null").select("node"))
    into, gone, counted, done = None, [], [], 0
    while rounds is None or done < rounds:
        parts = [r[0] for r in front.select(_part("node")).distinct().collect()]  # PARTS at most
        if not parts:
            break
        into = into or _by_target(edges, known)
        done += 1
        gone.append(front)
        met = into.where(F.col("part").isin(parts)).join(front.withColumnRenamed("node", "dst"), "dst", "left_semi")
        hit = stage(met.groupBy(F.col("src").alias("node"), "degree").agg(F.count("*").alias("n")))
        total = hit
        if counted:
            earlier = _union(counted).join(hit.select("node"), "node", "left_semi")
            total = earlier.unionByName(hit).groupBy("node", "degree").agg(F.sum("n").alias("n"))
        front = stage(total.where("n = degree").select("node"))
        counted.append(hit)
        if len(counted) > TABLES:
            before, after = counted, _union(counted).groupBy("node", "degree").agg(F.sum("n").alias("n")).where("n < degree")
            counted = [stage(after)]
            discard(*before)
        if len(gone) > TABLES:
            before, gone = gone, [stage(_union(gone))]
            discard(*before)
    alive = known.select("node")
    return alive.join(_union(gone), "node", "left_anti") if gone else alive
