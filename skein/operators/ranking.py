"""Top-k lists and measures of how far two rankings agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators.graph import ranked
from skein.stage import stage


def top_k(ranks: DataFrame, k: int) -> DataFrame:
    """``position, node, rank``: highest rank first, then least node. The limit is taken before positions, which see k rows."""
    best = ranks.orderBy(F.desc("rank"), "node").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("rank"), "node")).alias("position"), "node", "rank")


def signature(top: DataFrame, k: int = 10) -> DataFrame:
    """One row: the first k nodes, joined by commas."""
    rows = top.where(F.col("position") <= k).agg(F.sort_array(F.collect_list(F.struct("position", "node"))).alias("l"))
    return rows.select(F.array_join(F.transform("l", lambda x: x["node"].cast("string")), ",").alias("signature"))


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: shared over all nodes; 1 for two empty lists."""
    both = a.select("node", F.lit(1).alias("l")).unionByName(b.select("node", F.lit(2).alias("l"))).groupBy("node").agg(F.sum("l").alias("s"))
    counts = both.agg(F.count("*").alias("n"), F.count_if(F.col("s") == 3).alias("common"))
    return counts.select(F.when(F.col("n") == 0, 1.0).otherwise(F.col("common") / F.col("n")).alias("jaccard"))


def _common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("node", F.col("position").alias("pa"), F.col("rank").alias("ra")).join(b.select("node", F.col("position").alias("pb"), F.col("rank").alias("rb")), "node")


def kendall(a: DataFrame, b: DataFrame, ties: bool = False) -> DataFrame:
    """One row: tau over the nodes of both top-k lists. ``ties`` divides by concordant plus discordant pairs, else by all pairs. Null under two nodes."""
    c = _common(a, b)
    x, y = c.alias("x"), c.alias("y")
    sign = F.signum((F.col("x.pa") - F.col("y.pa")) * (F.col("x.pb") - F.col("y.pb")))
    # The lists are top-k, so this self-join has at most k * (k - 1) / 2 rows.
    pairs = x.join(y, F.col("x.node") < F.col("y.node")).select(sign.alias("s"))
    total = F.sum(F.abs("s")) if ties else F.count("*")
    return pairs.agg((F.sum("s") / F.nullif(total, F.lit(0))).alias("tau"))


#: Rows that a task counts inversions among at least, and parts of each ranking at most.
LEAST_PART, MOST_PARTS = 4096, 1000


def inversions(values: np.ndarray) -> int:
    """Pairs of places of which the earlier has the greater value: bit by bit, ones before zeros among values alike in higher bits."""
    total, v = 0, values.astype(np.int64)
    top = int(v.max(initial=0)).bit_length()
    for bit in reversed(range(top)):
        ones = (v >> bit) & 1
        before = np.cumsum(ones)
        head = v >> (bit + 1)
        first = np.flatnonzero(np.diff(head, prepend=-1))
        group = np.cumsum(np.diff(head, prepend=-1) != 0) - 1
        total += int(((before - (before[first] - ones[first])[group]) * (1 - ones)).sum())
        v = v[np.argsort(v >> bit, kind="stable")]
    return total


def kendall_full(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: tau over all nodes of both rankings (``node, rank``, ordered by rank from high to low, then node); concordant less discordant pairs over their sum, null under two nodes.

    Discordant pairs are counted, not listed: places in both orders are cut into parts of equal size. Pairs that lie in different parts of both follow from the counts of nodes by both parts (``MOST_PARTS`` squared
    numbers at most); pairs within a part of either are inversions in the other order, which one task counts for each part, in n log n.
    """
    both = a.select("node", F.col("rank").alias("ra")).join(b.select("node", F.col("rank").alias("rb")), "node")
    for side in "ab":
        key = F.struct((-F.col(f"r{side}")).alias("r"), "node")
        both = ranked(both.withColumn("_key", key), "_key", f"p{side}").drop("_key")
    both = stage(both.select("pa", "pb"))
    n = both.count()
    size = max(LEAST_PART, -(-n // MOST_PARTS))
    parted = both.select("pa", "pb", F.expr(f"pa div {size}").alias("ga"), F.expr(f"pb div {size}").alias("gb"))
    cells = parted.groupBy("ga", "gb").count().collect()  # MOST_PARTS squared rows at most
    grid = np.zeros((n // size + 1, n // size + 1), np.int64)
    for r in cells:
        grid[r["ga"], r["gb"]] = r["count"]
    later = grid[:, ::-1].cumsum(axis=1)[:, ::-1] - grid  # the same part of a, later parts of b
    apart = sum(int(x) * int(y) for x, y in zip(grid[1:].ravel(), later.cumsum(axis=0)[:-1].ravel(), strict=True) if x)
    # Within a part of a, all pairs; within a part of b, those in different parts of a.
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("ga").alias("part"), F.col("pa").alias("at"), F.col("pb").alias("v")), F.struct(F.lit(1).alias("side"), F.col("gb").alias("part"), F.col("pb").alias("at"), F.col("ga").alias("v"))))
    rows = parted.select(sides.alias("x")).select("x.*").repartition("side", "part").sortWithinPartitions("side", "part", "at")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, total = None, [], 0
        for batch in batches:
            key = batch.column("side").to_numpy() * (MOST_PARTS + 1) + batch.column("part").to_numpy()
            values = batch.column("v").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y > x and key[x] != now:
                    total += inversions(np.concatenate(held)) if held else 0
                    now, held = key[x], []
                held.append(values[x:y])
        total += inversions(np.concatenate(held)) if held else 0
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["inside"])

    inside = rows.mapInArrow(count, "inside long").agg(F.coalesce(F.sum("inside"), F.lit(0)).alias("inside"))
    pairs = n * (n - 1) // 2
    return inside.select(F.when(F.lit(pairs > 0), 1 - 2 * (F.col("inside") + apart) / F.lit(max(pairs, 1))).alias("tau"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """``side, node``: in both, only in the first, only in the second."""
    left, right = a.select("node"), b.select("node")
    return (
        left.intersect(right).select(F.lit("both").alias("side"), "node")
        .unionByName(left.exceptAll(right).select(F.lit("left").alias("side"), "node"))
        .unionByName(right.exceptAll(left).select(F.lit("right").alias("side"), "node"))
    )


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: greatest absolute and relative difference of common nodes' ranks."""
    gap = F.abs(F.col("ra") - F.col("rb"))
    return _common(a, b).agg(F.max(gap).alias("max_abs"), F.max(gap / F.greatest(F.abs("rb"), F.lit(1e-15))).alias("max_rel"))


def shift_histogram(a: DataFrame, b: DataFrame) -> DataFrame:
    """``bucket, nodes``: how far common nodes move: 0, 1, 2-5, 6-20, 21+."""
    shift = F.abs(F.col("pa") - F.col("pb"))
    bucket = F.when(shift == 0, "0").when(shift == 1, "1").when(shift <= 5, "2-5").when(shift <= 20, "6-20").otherwise("21+")
    return _common(a, b).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("nodes"))


def verdict(metrics: DataFrame) -> DataFrame:
    """``verdict`` of a row with ``rank_sum, overlap_pct, max_rel, tau``: pass, warn or fail."""
    good = (F.abs(F.col("rank_sum") - 1) < 1e-6) & (F.col("overlap_pct") >= 98) & (F.col("max_rel") < 1e-6) & (F.col("tau") >= 0.999)
    fair = (F.abs(F.col("rank_sum") - 1) < 1e-4) & (F.col("overlap_pct") >= 95) & (F.col("max_rel") < 1e-4) & (F.col("tau") >= 0.99)
    return metrics.withColumn("verdict", F.when(good, "pass").when(fair, "warn").otherwise("fail"))
