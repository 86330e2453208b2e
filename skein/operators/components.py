"""Connected components of an edge list, by alternating large-star and small-star rounds.

Each round is two joins of the edges with their nodes' least neighbours; its table is written to
the shared folder, so plans stay short and lost executors cost one round. Rounds grow with the logarithm
of the longest path, and partial aggregation takes the weight of nodes with very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from skein.stage import discard, stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the component's least node) of every node in ``edges`` (``a, b``; either direction, repeats and loops allowed)."""
    loops = edges.where("a = b").select(F.col("a").alias("node"))
    now = stage(edges.where("a <> b").select("a", "b").distinct())
    mark = None
    while True:
        seen = Observation()  # measured while the round's table is written
        measures = [F.count("*").alias("count"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("total")]
        after = stage(_small_star(_large_star(now)).observe(seen, *measures))
        count, total = (seen.get.get(k) for k in ("count", "total"))
        discard(now)
        now = after
        if (count, total) == mark or not count:
            break
        mark = (count, total)
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = found.select(F.col("component").alias("node"), "component")
    own = loops.select("node", F.col("node").alias("component"))
    return found.unionByName(roots).unionByName(own).groupBy("node").agg(F.min("component").alias("component"))
