"""PageRank by repeated join and aggregation.

r'(v) = (1 - beta) / N + beta D / N + beta sum over edges u -> v of r(u) / out-degree(u), where D is the rank on
nodes without out-edges. Edges carry their weight (multiplicity over out-degree) and are laid out once, bucketed by source: a round moves ranks to them and
sums by destination, and nothing else. Each node has a row of weight 0 to itself, so that the sums hold all nodes, their last rank, and
whether they are dead ends. A round's ranks are written to the shared folder; the dead ends' share and the change are measured as they are written.

A source with a large part of all edges is dealt over several buckets, to each of which its rank goes.

With ``blocks`` nodes are numbered and dealt into blocks, and edges lie packed between them (:mod:`skein.operators.cells`): a round then shuffles a sum for each node and block that has edges to it, not for each edge.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from skein.operators import cells, graph
from skein.stage import discard, stage, stage_bucketed

#: Sources with over 1 / HUBS of a bucket's mean number of edges are dealt over several; so there are at most HUBS x buckets of them.
HUBS = 4


def weighted(edges: DataFrame, distinct: bool = False) -> DataFrame:
    """``src, dst, w``. ``distinct`` counts repeated edges once but leaves the out-degree as it is, so their rank is lost."""
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    out = edges.groupBy("src").agg(F.count("*").alias("d"))
    return pairs.join(out, "src").select("src", "dst", ((F.lit(1) if distinct else F.col("n")) / F.col("d")).alias("w"))


@dataclass(frozen=True)
class Links:
    """A graph laid out for any number of runs: ``rows`` (``src, part, dst, w, own, dead``), its nodes (``node``), parts of hubs (``src, parts``; None without), number of nodes, and of dead ends."""

    rows: DataFrame
    everyone: DataFrame
    hubs: DataFrame | None
    nodes: int
    dead: int


@dataclass(frozen=True)
class Blocks:
    """A graph laid out in blocks: packed edges, numbers of nodes (``node, block, at``), out-degrees (``block, n``; packed doubles, 0 for dead ends), numbers of nodes and of dead ends."""

    links: cells.Cells
    numbers: DataFrame
    degrees: DataFrame
    nodes: int
    dead: int


def _prepare_blocks(edges: DataFrame, nodes: DataFrame | None, distinct: bool, blocks: int) -> Blocks:
    edges = stage(edges.select("src", "dst"))
    everyone = stage(graph.node_ids(edges) if nodes is None else nodes.select("node"))
    numbers, size = cells.numbered(everyone, "node", blocks)
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    seen = Observation()
    known = numbers.join(out, "node", "left").observe(seen, F.count("*").alias("nodes"), F.count_if(F.col("d").isNull()).alias("dead"))

    def pack(table: pa.Table) -> pa.Table:
        d = np.full(size, np.nan)  # places without a node
        d[table.column("at").to_numpy()] = table.column("d").to_numpy()
        return pa.table({"block": table.column("block")[:1], "n": pa.array([d.tobytes()], pa.binary())})

    degrees = stage(known.select("block", "at", F.coalesce(F.col("d").cast("double"), F.lit(0.0)).alias("d")).groupBy("block").applyInArrow(pack, "block int, n binary"))
    places = edges.distinct() if distinct else edges
    for k, block, at in (("src", "p", "x"), ("dst", "q", "y")):
        places = places.join(numbers.select(F.col("node").alias(k), F.col("block").alias(block), F.col("at").alias(at)), k)
    links = cells.cells(places, size)
    discard(edges, everyone)
    return Blocks(links, numbers, degrees, seen.get["nodes"] or 0, seen.get["dead"] or 0)


def _block_round(size: int, terms: list[tuple[int, float, float]]):
    """A block's next ranks and what of them lies on dead ends and how much they changed, for (number, constant, beta) of each run."""

    def make(table: pa.Table) -> pa.Table:
        own, came = table.filter(table.column("n").is_valid()), table.filter(table.column("sums").is_valid())
        d = np.frombuffer(own.column("n")[0].as_py(), np.float64)
        row = {"block": own.column("block")}
        parts = sorted(zip(*(came.column(c).to_pylist() for c in ("run", "places", "sums")), strict=True))  # always in one order
        for k, constant, beta in terms:
            mine = [p for p in parts if p[0] == k]
            got = cells.gathered([x for *_, x in mine], [x for _, x, _ in mine], size)
            before = np.frombuffer(own.column(f"v{k}")[0].as_py(), np.float64)
            v = np.where(np.isnan(d), 0.0, constant + beta * got)
            row |= {f"v{k}": pa.array([v.tobytes()], pa.binary()), f"lost{k}": pa.array([float(v[d == 0].sum())]), f"delta{k}": pa.array([float(np.abs(v - before).sum())])}
        return pa.table(row)

    return make


def _sent(ranks: DataFrame, now: list[int]) -> DataFrame:
    """``run, block, v``: what each place sends along an edge."""

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                d = np.frombuffer(batch.column("n")[r].as_buffer(), np.float64)
                for k in now:
                    v = np.frombuffer(batch.column(f"v{k}")[r].as_buffer(), np.float64) / np.where(d > 0, d, np.inf)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), batch.column("block").slice(r, 1), pa.array([v.tobytes()], pa.binary())], ["run", "block", "v"])

    return ranks.mapInArrow(divide, "run int, block int, v binary")


def _blocked(links: Blocks, runs: list[tuple[float, float | None]], max_iter: int, dead_ends: str, past: list[DataFrame] | None) -> list[tuple[DataFrame, int, float | None]]:
    """:func:`pageranks` over blocks."""
    n, size = max(links.nodes, 1), links.links.size
    betas = list(dict.fromkeys(beta for beta, _ in runs))
    number = {beta: k for k, beta in enumerate(betas)}

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                v = np.where(np.isnan(np.frombuffer(batch.column("n")[r].as_buffer(), np.float64)), 0.0, 1.0 / n).tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(r, 1), *[pa.array([v], pa.binary()) for _ in betas]], ["block", *[f"v{k}" for k in range(len(betas))]])

    def named(ranks: DataFrame, k: int) -> DataFrame:
        return links.numbers.join(cells.unpacked(ranks.select("block", F.col(f"v{k}").alias("v"))), ["block", "at"]).select("node", F.col("v").alias("rank"))

    ranks = links.degrees.mapInArrow(begin, "block int, " + ", ".join(f"v{k} binary" for k in range(len(betas))))
    lost, rounds, kept = dict.fromkeys(betas, links.dead / n), 0, True
    done: dict[int, tuple[DataFrame, int, float | None]] = {}
    delta: dict[float, float | None] = dict.fromkeys(betas)
    if past is not None:
        past.append(named(ranks, 0).select(F.lit(0).alias("iteration"), "node", "rank"))
    while rounds < max_iter and len(done) < len(runs):
        now = list(dict.fromkeys(beta for k, (beta, _) in enumerate(runs) if k not in done))
        at = [number[b] for b in now]
        state = ranks.join(links.degrees, "block")
        terms = [(number[b], (1 - b) / n + (lost[b] * b / n if dead_ends == "spread" else 0.0), b) for b in now]
        both = state.unionByName(links.links.sums(_sent(state, at), "run"), allowMissingColumns=True)
        schema = "block int, " + ", ".join(f"v{k} binary, lost{k} double, delta{k} double" for k in at)
        seen = Observation()
        after = both.groupBy("block").applyInArrow(_block_round(size, terms), schema)
        after = stage(after.observe(seen, *[F.sum(f"{c}{k}").alias(f"{c}{k}") for k in at for c in ("lost", "delta")]).select("block", *[f"v{k}" for k in at]))
        rounds += 1
        if not kept:
            discard(ranks)
        ranks, kept = after, past is not None
        if past is not None:
            past.append(named(ranks, 0).select(F.lit(rounds).alias("iteration"), "node", "rank"))
        measured = {beta for k, (beta, eps) in enumerate(runs) if k not in done and eps is not None}
        for b in now:
            lost[b] = seen.get[f"lost{number[b]}"] or 0.0
            delta[b] = (seen.get[f"delta{number[b]}"] or 0.0) if b in measured else None
        for k, (b, eps) in enumerate(runs):
            if k not in done and eps is not None and delta[b] < eps:
                done[k], kept = (named(ranks, number[b]), rounds, delta[b]), True
    for k, (b, eps) in enumerate(runs):
        if k not in done:
            done[k] = (named(ranks, number[b]), rounds, None if eps is None else delta[b])
    return [done[k] for k in range(len(runs))]


def _counted(edges: DataFrame) -> DataFrame:
    """``src, dst, n``: each edge once, with how often it comes."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


def prepare(edges: DataFrame, nodes: DataFrame | None = None, distinct: bool = False, blocks: int | None = None, counted: bool = False) -> Links | Blocks:
    """``counted`` edges come once, with how often they are there (``src, dst, n``)."""
    if blocks:
        return _prepare_blocks(edges.withColumn("n", F.explode(F.sequence(F.lit(1), "n"))) if counted else edges, nodes, distinct, blocks)
    spark = edges.sparkSession
    pairs = stage(edges if counted else _counted(edges))
    sums = [F.sum("n").alias("d"), F.count("n").alias("c")]
    if nodes is None:
        known = graph.node_ids(pairs, *sums).withColumnRenamed("node", "src")
    else:
        known = nodes.select(F.col("node").alias("src")).join(pairs.groupBy("src").agg(*sums), "src", "left")
    seen = Observation()
    known = stage(known.observe(seen, F.count("*").alias("nodes"), F.count_if(F.col("d").isNull()).alias("dead"), F.sum("c").alias("links")))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, (seen.get["links"] or 0) // (HUBS * buckets))
    hubs = known.where(F.col("c") > most).select("src", F.ceil(F.col("c") / most).cast("int").alias("parts"))
    few = hubs.isEmpty()
    hubs = None if few else stage(hubs)  # each round reads them
    part = F.lit(0) if few else F.coalesce(F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int"), F.lit(0))
    linked = pairs.join(known.select("src", "d"), "src")
    linked = linked if few else linked.join(F.broadcast(hubs), "src", "left")  # at most HUBS x buckets rows
    weight = (F.lit(1) if distinct else F.col("n")) / F.col("d")
    rows = linked.select("src", part.alias("part"), "dst", weight.alias("w"), F.lit(False).alias("own"), F.lit(None).cast("boolean").alias("dead"))
    rows = rows.unionByName(known.select("src", F.lit(0).alias("part"), F.col("src").alias("dst"), F.lit(0.0).alias("w"), F.lit(True).alias("own"), F.col("d").isNull().alias("dead")))
    # Without hubs all parts are 0: a join on them would be folded to one on sources alone, which buckets by both don't serve, so that edges would move each round.
    rows = stage_bucketed(rows.drop("part"), "src") if few else stage_bucketed(rows, "src", "part")
    discard(pairs)
    return Links(rows, known.select(F.col("src").alias("node")), hubs, seen.get["nodes"], seen.get["dead"])


def pagerank(
    edges: DataFrame | Links | Blocks,
    nodes: DataFrame | None = None,
    beta: float = 0.85,
    eps: float | None = None,
    max_iter: int = 200,
    dead_ends: str = "spread",
    distinct: bool = False,
    blocks: int | None = None,
    history: bool = False,
) -> tuple[DataFrame, int, float | None]:
    """``node, rank``; the rounds taken; the last L1 change (None without ``eps``).

    ``edges``: the edges, or what :func:`prepare` made of them (then ``nodes``, ``distinct`` and ``blocks`` are its business).
    ``dead_ends``: "spread" shares out their rank, "ignore" lets it go, "delete" ranks only what
    :func:`skein.operators.graph.prune_dead_ends` leaves and gives the rest 0, normalised. ``blocks`` lays edges out packed between so many blocks of nodes, or more; the result is the same.
    ``history`` returns all rounds, with ``iteration``.
    """
    if not 0 <= beta <= 1:
        raise ValueError("beta lies outside 0..1")
    if dead_ends not in ("spread", "ignore", "delete"):
        raise ValueError(f"unknown treatment of dead ends: {dead_ends}")
    if dead_ends == "delete":
        pairs = stage(_counted(edges))
        known = stage(graph.node_ids(pairs, F.count("n").alias("degree")))
        everyone = (known if nodes is None else nodes).select("node")
        alive = stage(graph.prune_dead_ends(pairs, known=known))
        # What has an edge to a node that is left is left too, but for null, which no join meets.
        inner = pairs.where("src is not null").join(alive.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "n")
        ranks, rounds, delta = pagerank(prepare(inner, alive, distinct, blocks, counted=True), beta=beta, eps=eps, max_iter=max_iter)
        discard(pairs, alive)
        full = everyone.join(normalised(ranks), "node", "left").select("node", F.coalesce("rank", F.lit(0.0)).alias("rank"))
        return full, rounds, delta
    links = edges if isinstance(edges, Links | Blocks) else prepare(edges, nodes, distinct, blocks)
    if not history:
        return pageranks(links, [(beta, eps)], max_iter, dead_ends)[0]
    past: list[DataFrame] = []
    _, rounds, delta = pageranks(links, [(beta, eps)], max_iter, dead_ends, past)[0]
    return _history(past), rounds, delta


def _history(past: list[DataFrame]) -> DataFrame:
    out = past[0]
    for p in past[1:]:
        out = out.unionByName(p)
    return out


def pageranks(links: Links | Blocks, runs: list[tuple[float, float | None]], max_iter: int = 200, dead_ends: str = "spread", past: list[DataFrame] | None = None) -> list[tuple[DataFrame, int, float | None]]:
    """What :func:`pagerank` returns for each of several (beta, eps) on one graph, in one row of rounds: edges are read and destinations shuffled once a round for all.

    A run ends in the round in which its change falls below its own eps; runs of one beta share their ranks. ``past`` gets the first beta's ranks of each round.
    """
    if isinstance(links, Blocks):
        return _blocked(links, runs, max_iter, dead_ends, past)
    n = max(links.nodes, 1)
    betas = list(dict.fromkeys(beta for beta, _ in runs))
    column = {beta: f"r{k}" for k, beta in enumerate(betas)}
    ranks = links.everyone.select("node", *[F.lit(1.0 / n).alias(c) for c in column.values()])
    lost, rounds, kept = dict.fromkeys(betas, links.dead / n), 0, True
    done: dict[int, tuple[DataFrame, int, float | None]] = {}
    delta: dict[float, float | None] = dict.fromkeys(betas)
    if past is not None:
        past.append(ranks.select(F.lit(0).alias("iteration"), "node", F.col("r0").alias("rank")))
    while rounds < max_iter and len(done) < len(runs):
        now = list(dict.fromkeys(beta for k, (beta, _) in enumerate(runs) if k not in done))
        measured = {beta for k, (beta, eps) in enumerate(runs) if k not in done and eps is not None}
        sent = ranks.select(F.col("node").alias("src"), *[column[b] for b in now])
        keys = ["src"] if links.hubs is None else ["src", "part"]
        if links.hubs is not None:
            sent = sent.join(F.broadcast(links.hubs), "src", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        got = links.rows.join(sent, keys).groupBy(F.col("dst").alias("node"))
        sums = [F.sum(F.col(column[b]) * F.col("w")).alias(f"got_{column[b]}") for b in now]
        sums += [F.max(F.when(F.col("own"), F.col(column[b]))).alias(f"before_{column[b]}") for b in now if b in measured]
        constant = {b: (1 - b) / n + (lost[b] * b / n if dead_ends == "spread" else 0.0) for b in now}
        made = [(constant[b] + b * F.col(f"got_{column[b]}")).alias(column[b]) for b in now]
        after = got.agg(*sums, F.max("dead").alias("dead")).select("node", *made, "dead", *[f"before_{column[b]}" for b in now if b in measured])
        measures = [F.sum(F.when(F.col("dead"), F.col(column[b]))).alias(f"lost_{column[b]}") for b in now]
        measures += [F.sum(F.abs(F.col(column[b]) - F.col(f"before_{column[b]}"))).alias(f"delta_{column[b]}") for b in now if b in measured]
        seen = Observation()
        after = stage(after.observe(seen, *measures).select("node", *[column[b] for b in now]))
        rounds += 1
        if not kept:
            discard(ranks)
        ranks, kept = after, past is not None
        if past is not None:
            past.append(ranks.select(F.lit(rounds).alias("iteration"), "node", F.col("r0").alias("rank")))
        for b in now:
            lost[b] = seen.get[f"lost_{column[b]}"] or 0.0
            delta[b] = (seen.get[f"delta_{column[b]}"] or 0.0) if b in measured else None
        for k, (b, eps) in enumerate(runs):
            if k not in done and eps is not None and delta[b] < eps:
                done[k], kept = (ranks.select("node", F.col(column[b]).alias("rank")), rounds, delta[b]), True
    for k, (b, eps) in enumerate(runs):
        if k not in done:
            done[k] = (ranks.select("node", F.col(column[b]).alias("rank")), rounds, None if eps is None else delta[b])
    return [done[k] for k in range(len(runs))]


def normalised(ranks: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Ranks over their sum, where that is off 1 by more than ``tolerance``."""
    total = ranks.agg(F.sum("rank").alias("total"))
    off = F.abs(F.col("total") - 1) > tolerance
    return ranks.crossJoin(F.broadcast(total)).select("node", F.when(off & (F.col("total") != 0), F.col("rank") / F.col("total")).otherwise(F.col("rank")).alias("rank"))
