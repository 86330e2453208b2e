"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import graph, ranking
from skein.operators.pagerank import normalised, pagerank, pageranks, prepare
from skein.plans.inputs import BIPARTITE, EDGES, FOREST, NODES, SPARSE, edges_bipartite, edges_forest, edges_part, edges_sparse
from skein.plans.registry import Registry
from skein.sources import text
from skein.stage import stage

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
ROUNDS = 10
DEGREES = """deg as (select node, sum(o) as out_degree, sum(1 - o) as in_degree, count(*) as degree
  from (select src as node, 1 as o from edges union all select dst, 0 from edges) t group by node)"""


def rank_sql(rounds: int = ROUNDS, dead: str = "spread", beta: float = 0.85, weight: str = "1.0", edges: str = EDGES, prefix: str = "r") -> str:
    """CTEs of unrolled PageRank; the last is ``{prefix}{rounds}(node, rank)``."""
    lost = f"(select coalesce(sum(rank), 0) from {prefix}{{0}} where node not in (select src from edges)) * {beta} / (select count(*) from nodes)" if dead == "spread" else "0.0"
    parts = [edges, NODES] if edges else []
    parts.append(f"{prefix}w as (select e.src, e.dst, {weight} / d as w from {'(select distinct src, dst from edges)' if weight == '1' else 'edges'} e join (select src, count(*) as d from edges group by src) o on o.src = e.src)")
    parts.append(f"{prefix}0 as (select node, 1.0::double / (select count(*) from nodes) as rank from nodes)")
    for k in range(rounds):
        got = f"select dst, sum(rank * w) as got from {prefix}w join {prefix}{k} on src = node group by dst"
        parts.append(f"{prefix}{k + 1} as materialized (select node, {1 - beta}::double / (select count(*) from nodes) + {lost.format(k)} + {beta} * coalesce(got, 0) as rank from nodes left join ({got}) g on g.dst = node)")
    return "with " + ", ".join(parts) if edges else ", ".join(parts)


def ranked(ranks):
    return ranks.select("node", F.round("rank", 10).alias("rank"))


@query(f"with {EDGES} select src, dst from edges where src <> dst")
def src_edges(spark, d):
    lines = edges_part(spark, d).select(F.concat_ws(" ", "src", "dst").alias("value"))
    return text.parse_edges(lines).where("src <> dst")


@query(f"with {EDGES} select src, dst from edges")
def src_edges_verify(spark, d):
    lines = edges_part(spark, d).select(F.explode(F.array(F.concat_ws("\t", "src", "dst"), F.lit(" "))).alias("value"))
    return text.parse_edges(lines, strict=False)


@query(f"with {SPARSE} select node as node_id, row_number() over (order by node) - 1 as idx from (select src as node from sparse union select dst from sparse) t")
def graph_idspace(spark, d):
    return graph.id_space(edges_sparse(spark, d))


@query(f"""with {SPARSE}, ids as (select node, row_number() over (order by node) - 1 as idx from (select src as node from sparse union select dst from sparse) t)
select s.idx as src, t.idx as dst from sparse join ids s on s.node = sparse.src join ids t on t.node = sparse.dst""")
def graph_remap(spark, d):
    e = edges_sparse(spark, d)
    return graph.remap(e, graph.id_space(e))


@query(f"with {BIPARTITE}, {NODES} select node, count(src) as out_degree from nodes left join edges on src = node group by node")
def graph_outdeg(spark, d):
    return graph.degrees(edges_bipartite(spark, d)).select("node", "out_degree")


@query(f"""with {EDGES}, {NODES}, o as (select node, count(src) as n, string_agg(cast(dst as varchar), ',' order by dst) as adjacency from nodes left join edges on src = node group by node)
select node, cast(sum(n) over (order by node) - n as bigint) as row_start, n as out_degree, coalesce(adjacency, '') as adjacency from o""")
def graph_csr(spark, d):
    return graph.csr(edges_part(spark, d)).withColumn("adjacency", F.array_join(F.transform("adjacency", lambda x: x.cast("string")), ","))


@query(f"""with {EDGES}, {NODES}, rows as (select node, count(src) as out_degree, list(dst) filter (dst is not null) as adjacency from nodes left join edges on src = node group by node)
select (select count(*) from edges) as edges, cast(sum(out_degree) as bigint) as in_rows, count(*) filter (coalesce(len(adjacency), 0) <> out_degree) as wrong_rows,
(select count(*) from edges where dst not in (select node from rows)) as missing from rows""")
def graph_csr_validate(spark, d):
    e = edges_part(spark, d)
    return graph.csr_check(e, graph.csr(e))


@query(f"with {EDGES} select src, dst from edges")
def graph_csr_edges(spark, d):
    return graph.csr_edges(graph.csr(edges_part(spark, d)))


@query(f"""with {EDGES}, n as (select max(greatest(src, dst)) + 1 as n from edges), b as (select range as block from range(16)),
bounds as (select block, block * n // 16 as first, (block + 1) * n // 16 - 1 as last from b, n)
select block, first, last, count(src) as edges from bounds left join edges on dst between first and last group by block, first, last""")
def graph_blocks(spark, d):
    e = edges_part(spark, d)
    nodes = e.agg(F.max(F.greatest("src", "dst"))).first()[0] + 1
    return graph.blocks(e, nodes, 16)


@query(f"with {EDGES}, {DEGREES} select node, cast(out_degree as bigint) as out_degree, cast(in_degree as bigint) as in_degree, degree from deg")
def graph_degrees(spark, d):
    return graph.degrees(edges_part(spark, d))


@query(f"""with {EDGES}, {DEGREES}, m as (select cast(max(greatest(out_degree, in_degree)) as bigint) as m from deg)
select range as degree, (select count(*) from deg where out_degree = range) as out_nodes, (select count(*) from deg where in_degree = range) as in_nodes
from range((select m + 1 from m))""")
def graph_degree_hist(spark, d):
    return graph.degree_histogram(edges_part(spark, d))


@query(f"""with {EDGES}, {DEGREES} select (select count(*) from deg) as nodes, (select count(*) from edges) as edges,
(select round(avg(out_degree), 6) from deg) as avg_out, (select cast(max(out_degree) as bigint) from deg) as max_out, (select cast(max(in_degree) as bigint) from deg) as max_in,
(select count(*) from deg where out_degree = 0) as dead_ends, (select count(*) from edges where src = dst) as self_loops,
(select count(*) from edges) - (select count(*) from (select distinct src, dst from edges) t) as repeated""")
def graph_profile(spark, d):
    return graph.profile(edges_part(spark, d)).withColumn("avg_out", F.round("avg_out", 6))


@query(f"""with {BIPARTITE}, {NODES} select count(*) as dead_ends, round(count(*) / (select count(*) from nodes), 6) as ratio
from nodes where node not in (select src from edges)""")
def graph_deadends(spark, d):
    deg = graph.degrees(edges_bipartite(spark, d))
    n = F.count_if(F.col("out_degree") == 0)
    return deg.agg(n.alias("dead_ends"), F.round(n / F.count("*"), 6).alias("ratio"))


@query(f"with {SPARSE} select range as node from range((select max(greatest(src, dst)) + 1 from sparse)) where range not in (select src from sparse union select dst from sparse)")
def graph_isolated(spark, d):
    e = edges_sparse(spark, d)
    return graph.isolated(e, e.agg(F.max(F.greatest("src", "dst"))).first()[0] + 1)


@query(f"with {EDGES} select src as node, count(*) as loops from edges where src = dst group by src")
def graph_selfloops(spark, d):
    return edges_part(spark, d).where("src = dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("loops"))


@query(f"with {EDGES} select src, dst, count(*) as times from edges group by src, dst having count(*) > 1")
def graph_dupedges(spark, d):
    return edges_part(spark, d).groupBy("src", "dst").agg(F.count("*").alias("times")).where("times > 1")


@query(f"with {FOREST} select src as component, count(*) + 1 as nodes from edges group by src")
def graph_wcc(spark, d):
    return graph.component_sizes(edges_forest(spark, d))


def _labels_sql(rounds: int) -> str:
    """Least labels spread over all edges, and along the labels themselves, round by round; the last is ``c{rounds}(node, label)``."""
    parts = [f"with {EDGES}, {NODES}, both_ways as (select src as a, dst as b from edges union select dst, src from edges), c0 as (select node, node as label from nodes)"]
    for k in range(rounds):
        parts.append(f"n{k} as materialized (select node, least(label, coalesce(m, label)) as label from c{k} left join (select a, min(label) as m from both_ways join c{k} on node = b group by a) t on a = node)")
        parts.append(f"c{k + 1} as materialized (select x.node, y.label from n{k} x join n{k} y on y.node = x.label)")
    return ", ".join(parts)


@query(_labels_sql(12) + " select node, label as component from c12")
def graph_components_all(spark, d):
    """Components over all edges."""
    from skein.operators.components import connected_components

    return connected_components(edges_part(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b")))


_WHOLE = ", ".join(f"{n}{k + 1} as materialized (select src, dst from {n}{k} where dst in (select src from {n}{k}))" for n in "pb" for k in range(24))


@query(f"""with {EDGES}, {BIPARTITE.replace('edges as', 'two as')}, p0 as (select distinct src, dst from edges), b0 as (select src, dst from two), {_WHOLE}
select distinct 'part' as graph, src as node from p24 union all select distinct 'bipartite', src from b24""")
def graph_prune_deadends_all(spark, d):
    """The fixpoint over all edges of both graphs: parts, and suppliers to parts (where everything is a dead end in the end)."""
    left = [graph.prune_dead_ends(e(spark, d)).select(F.lit(name).alias("graph"), "node") for name, e in (("part", edges_part), ("bipartite", edges_bipartite))]
    return left[0].unionByName(left[1])


@query(rank_sql() + f" select node, round(rank, 10) as rank from r{ROUNDS}")
def pr_csr(spark, d):
    return ranked(pagerank(edges_part(spark, d), max_iter=ROUNDS)[0])


@query(rank_sql(edges=BIPARTITE) + f" select node, round(rank, 10) as rank from r{ROUNDS}")
def pr_dangling(spark, d):
    return ranked(pagerank(edges_bipartite(spark, d), max_iter=ROUNDS)[0])


@query(rank_sql() + f" select node, round(rank, 10) as rank from r{ROUNDS}")
def pr_block(spark, d):
    return ranked(pagerank(edges_part(spark, d), max_iter=ROUNDS, blocks=8)[0])


@query(rank_sql(weight="1") + f" select node, round(rank, 10) as rank from r{ROUNDS}")
def pr_dense(spark, d):
    return ranked(pagerank(edges_part(spark, d), max_iter=ROUNDS, distinct=True)[0])


@query(rank_sql(3) + " " + " union all ".join(f"select {k}::int as iteration, node, round(rank, 10) as rank from r{k}" for k in range(4)))
def pr_steps(spark, d):
    return pagerank(edges_part(spark, d), max_iter=3, history=True)[0].select("iteration", "node", F.round("rank", 10).alias("rank"))


@query(rank_sql(dead="ignore", edges=BIPARTITE) + f" select node, round(rank, 10) as rank from r{ROUNDS}")
def pr_ignore(spark, d):
    return ranked(pagerank(edges_bipartite(spark, d), max_iter=ROUNDS, dead_ends="ignore")[0])


@query(rank_sql(dead="ignore", edges=BIPARTITE) + f" select node, round(rank / (select sum(rank) from r{ROUNDS}), 10) as rank from r{ROUNDS}")
def pr_normalize(spark, d):
    return ranked(normalised(pagerank(edges_bipartite(spark, d), max_iter=ROUNDS, dead_ends="ignore")[0]))


DELETE_ALL = (
    "with "
    + EDGES.replace("edges as", "e0 as")
    + ", every as (select src as node from e0 union select dst from e0), p0 as (select distinct src, dst from e0), "
    + ", ".join(f"p{k + 1} as materialized (select src, dst from p{k} where dst in (select src from p{k}))" for k in range(24))
    + ", nodes as (select distinct src as node from p24), edges as (select src, dst from e0 where src in (select node from nodes) and dst in (select node from nodes)), "
    + rank_sql(edges="")
)


@query(DELETE_ALL + f" select every.node, round(coalesce(rank, 0.0), 10) as rank from every left join r{ROUNDS} r on r.node = every.node")
def pr_delete_all(spark, d):
    """All edges, repeated ones and self-loops included, as in the reference."""
    return ranked(pagerank(edges_part(spark, d), max_iter=ROUNDS, dead_ends="delete")[0])


@query()
def pr_run(spark, d):
    """Rounds, last change and rank sum of a run to convergence."""
    ranks, rounds, delta = pagerank(edges_part(spark, d), eps=1e-8)
    return ranks.agg(F.round(F.sum("rank"), 6).alias("rank_sum"), F.lit(rounds).alias("rounds"), F.lit(delta < 1e-8).alias("converged"))


@query()
def pr_compare_strategies(spark, d):
    """Each treatment of dead ends against spreading them: rounds, last change, rank sum, nodes with and without rank, and overlap of the first ten nodes."""
    e, out, base = stage(edges_bipartite(spark, d)), None, None
    links = prepare(e)
    for how in ("spread", "ignore", "delete"):
        ranks, rounds, delta = pagerank(e if how == "delete" else links, dead_ends=how, eps=1e-6)
        top = ranking.top_k(ranks, 10)
        base = base or top
        counts = [F.count_if(F.col("rank") > 0).alias("active"), F.count_if(F.col("rank") == 0).alias("removed"), F.lit(delta).alias("delta")]
        row = ranks.agg(F.lit(how).alias("dead_ends"), F.round(F.sum("rank"), 6).alias("rank_sum"), F.lit(rounds).alias("rounds"), *counts).crossJoin(ranking.jaccard(top, base))
        out = row if out is None else out.unionByName(row)
    return out


TOP = rank_sql() + f", top as (select row_number() over (order by rank desc, node) as position, node, rank from r{ROUNDS})"
TWO = rank_sql() + ", " + rank_sql(edges="", prefix="s", beta=0.7) + "".join(
    f", {n} as (select row_number() over (order by round(rank, 12) desc, node) as position, node, round(rank, 12) as rank from {r}{ROUNDS} order by 1 limit 50)" for n, r in (("a", "r"), ("b", "s"))
)


def _top(ranks):
    return ranking.top_k(ranks.withColumn("rank", F.round("rank", 12)), 50)


def _one(links):
    return _top(pagerank(links, max_iter=ROUNDS)[0])


def _both(spark, d):
    """Ranks with beta 0.85 and with 0.7, in the same rounds."""
    return [ranks for ranks, _, _ in pageranks(prepare(edges_part(spark, d), blocks=8), [(0.85, None), (0.7, None)], ROUNDS)]


def _two(spark, d):
    return tuple(map(_top, _both(spark, d)))


@query(TOP.replace("order by rank desc", "order by round(rank, 12) desc") + " select cast(position as int) as position, node, round(rank, 12) as rank from top where position <= 100")
def rank_topk(spark, d):
    ranks = pagerank(edges_part(spark, d), max_iter=ROUNDS)[0].withColumn("rank", F.round("rank", 12))
    return ranking.top_k(ranks, 100)


@query(TWO + " select string_agg(cast(node as varchar), ',' order by position) as signature from a where position <= 10")
def rank_signature(spark, d):
    return ranking.signature(_one(prepare(edges_part(spark, d))))


@query(TWO + " select round((select count(*) from a join b using (node)) / (select count(*) from (select node from a union select node from b) t), 10) as jaccard")
def rank_jaccard(spark, d):
    return ranking.jaccard(*_two(spark, d)).select(F.round("jaccard", 10).alias("jaccard"))


_PAIRS = ", c as (select a.node, a.position as pa, b.position as pb, a.rank as ra, b.rank as rb from a join b on a.node = b.node)"


@query(TWO + _PAIRS + " select round(sum(sign((x.pa - y.pa) * (x.pb - y.pb))) / count(*), 10) as tau from c x join c y on x.node < y.node")
def rank_kendall(spark, d):
    return ranking.kendall(*_two(spark, d)).select(F.round("tau", 10).alias("tau"))


_WHOLE = rank_sql() + ", " + rank_sql(edges="", prefix="s", beta=0.7) + "".join(f", {n} as (select node, row_number() over (order by round(rank, 12) desc, node) as position from {r}{ROUNDS})" for n, r in (("wa", "r"), ("wb", "s")))


@query(_WHOLE + """, c as (select node, wa.position as pa, wb.position as pb from wa join wb using (node))
select round(sum(sign((x.pa - y.pa) * (x.pb - y.pb))) / sum(abs(sign((x.pa - y.pa) * (x.pb - y.pb)))), 10) as tau from c x join c y on x.node < y.node""")
def rank_kendall_full(spark, d):
    """Agreement of two whole rankings, by counted inversions."""
    a, b = (ranks.withColumn("rank", F.round("rank", 12)) for ranks in _both(spark, d))
    return ranking.kendall_full(a, b).select(F.round("tau", 10).alias("tau"))


@query(TWO + """ select 'both' as side, node from a where node in (select node from b) union all select 'left', node from a where node not in (select node from b)
union all select 'right', node from b where node not in (select node from a)""")
def rank_overlap(spark, d):
    return ranking.overlap(*_two(spark, d))


@query(TWO + _PAIRS + " select round(max(abs(ra - rb)), 9) as max_abs, round(max(abs(ra - rb) / greatest(abs(rb), 1e-15)), 6) as max_rel from c")
def rank_diff(spark, d):
    return ranking.difference(*_two(spark, d)).select(F.round("max_abs", 9).alias("max_abs"), F.round("max_rel", 6).alias("max_rel"))


@query(TWO + _PAIRS + """, s as (select abs(pa - pb) as s from c)
select case when s = 0 then '0' when s = 1 then '1' when s <= 5 then '2-5' when s <= 20 then '6-20' else '21+' end as bucket, count(*) as nodes from s group by 1""")
def rank_shift_hist(spark, d):
    return ranking.shift_histogram(*_two(spark, d))


def _verdict_sql(name: str, a: str, b: str, rank_sum: str) -> str:
    return f"""select '{name}' as compared, rank_sum, overlap_pct, max_rel, case when abs(rank_sum - 1) < 1e-6 and overlap_pct >= 98 and max_rel < 1e-6 and tau >= 0.999 then 'pass'
  when abs(rank_sum - 1) < 1e-4 and overlap_pct >= 95 and max_rel < 1e-4 and tau >= 0.99 then 'warn' else 'fail' end as verdict
from (select {rank_sum} as rank_sum, 100.0::double * count(*) / 50 as overlap_pct, round(max(abs({a}.rank - {b}.rank) / {b}.rank), 6) as max_rel from {a} join {b} on {a}.node = {b}.node) m,
(select sum(sign((x.pa - y.pa) * (x.pb - y.pb))) / count(*) as tau from (select {a}.node, {a}.position as pa, {b}.position as pb from {a} join {b} on {a}.node = {b}.node) x
  join (select {a}.node, {a}.position as pa, {b}.position as pb from {a} join {b} on {a}.node = {b}.node) y on x.node < y.node) t"""


_SUM = f"(select round(sum(rank), 6) from r{ROUNDS})"


@query(TWO + " " + _verdict_sql("far", "a", "b", _SUM).replace("'far' as compared, ", ""))
def rank_verdict(spark, d):
    ranks, far = _both(spark, d)
    return _judged(ranks, _top(ranks), _top(far))


def _judged(ranks, a, b):
    total = ranks.agg(F.round(F.sum("rank"), 6).alias("rank_sum"))
    both = ranking.overlap(a, b).agg((100.0 * F.count_if(F.col("side") == "both") / 50).alias("overlap_pct"))
    rel = ranking.difference(a, b).select(F.round("max_rel", 6).alias("max_rel"))
    return ranking.verdict(total.crossJoin(both).crossJoin(rel).crossJoin(ranking.kendall(a, b))).drop("tau")  # one row each


_CLOSE = ", same_ as (select * from a), close as (select row_number() over (order by rank desc, node) as position, node, rank from (select node, round(rank * (1 + 4e-5 * (node % 2)), 12) as rank from r10) t order by 1 limit 50)"


@query(TWO + _CLOSE + " " + " union all ".join(_verdict_sql(n, "a", o, _SUM) for n, o in (("same", "a2"), ("close", "close"), ("far", "b"))).replace("a2", "same_"))
def rank_verdicts(spark, d):
    """A ranking against itself, against one with slightly other ranks, and against one of another beta."""
    ranks, far = _both(spark, d)
    near = ranks.withColumn("rank", F.col("rank") * (1 + 4e-5 * (F.col("node") % 2)))
    out = None
    for name, other in (("same", _top(ranks)), ("close", _top(near)), ("far", _top(far))):
        row = _judged(ranks, _top(ranks), other).select(F.lit(name).alias("compared"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query()
def sweep_beta(spark, d):
    """Rounds to converge and overlap with beta 0.85 for a grid of betas."""
    betas, out = (0.7, 0.8, 0.85, 0.9, 0.95), None
    found = dict(zip(betas, pageranks(prepare(edges_part(spark, d)), [(beta, 1e-8) for beta in betas]), strict=True))
    base = ranking.top_k(found[0.85][0], 10)
    for beta, (ranks, rounds, _) in found.items():
        row = ranking.jaccard(ranking.top_k(ranks, 10), base).select(F.lit(beta).alias("beta"), F.lit(rounds).alias("rounds"), "jaccard")
        out = row if out is None else out.unionByName(row)
    return out


@query()
def sweep_eps(spark, d):
    """Rounds to converge for a grid of limits."""
    limits = (1e-6, 1e-8, 1e-10)
    found = pageranks(prepare(edges_part(spark, d)), [(0.85, eps) for eps in limits])
    return spark.createDataFrame([(eps, rounds) for eps, (_, rounds, _) in zip(limits, found, strict=True)], "eps double, rounds int")


@query(TWO + " select position::int as position, node || ' ' || printf('%.10f', rank) as value from a")
def sink_topk(spark, d):
    return text.ranking_lines(_one(prepare(edges_part(spark, d))))


query.also({n: f"{n}_all" for n in ("graph_components", "graph_prune_deadends", "pr_delete")})
