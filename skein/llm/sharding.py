"""Shards of near-equal size by a k-d tree over document metadata.

A node that must give k shards is split where floor(k/2)/k of its weight lies to the left, along the
dimension on which it is widest (its range as a share of the whole table's), until every leaf is one shard. The
weighted medians of all nodes of a level are found together, by histograms that Spark aggregates: each
round narrows the nodes' intervals, until the rows left in them are few and are ordered
exactly. At most ``SUMS`` sums or rows (``LEAST_BINS`` a node, if that is more) reach the driver in a round, however large the table is.
A level's cuts are array literals that rows look up by their node, and its rows are written before the next level.

Rows of equal text are one point of the tree, with the sum of their weights and the least of their metadata, so they share a shard whatever their languages and sources are. Only a group of
copies over ``GROUP`` of a shard, and over the largest single text, is parted, into points of about that weight. Points are ordered by (dimension, heaviest first, hash of text and part). So a
cut is off by half of the point at it, and a shard by the sum of that over its levels (log2 of the shards): shards are near equal unless single texts weigh as much as
shards. Documents are read once; the tree works on a narrow table of numbers, and rows find their point by the text's hash, its size and the part. Slots within a shard come from counts of
(shard, bucket) and a rank within each bucket, so no task ranks a whole shard. Only built-in functions are used.

Special cases: a null text has no bytes (size 16 in the query) and hash 0; null metadata counts as
0; numbers beyond 2**61 in size count as that; repeated rows and null ids are rows like others; a table with fewer rows than shards, or an
empty one, leaves shards empty; other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.stage import discard, stage

#: Sums, or rows, that come to the driver in a round for all nodes together, and bins that a node has at least.
SUMS, LEAST_BINS = 1 << 16, 64
#: Of a shard: what a cut may be off so that points alike in dimension and content stay together; weight of a group of copies that is parted.
TOLERANCE, GROUP = 0.01, 0.05
SLOT_BUCKETS = 256
#: Numbers beyond it count as it, so that differences are whole numbers of 64 bits.
FAR = 1 << 61


@dataclass
class Node:
    """A subtree for shards first .. first + shards - 1; ``cut`` is the least (dimension, content, tie) of the right side."""

    first: int
    shards: int
    dim: int = 0
    cut: tuple[int, int, int] = (0, 0, 0)

    def kids(self) -> list[Node]:
        left = self.shards // 2
        return [Node(self.first, left), Node(self.first + left, self.shards - left)]


@dataclass
class Search:
    """Where a node's cut may still lie: the keys in ``fixed`` are known, the next is in lo..hi; ``before``: weight left of that."""

    node: Node
    target: float
    lo: int
    hi: int
    fixed: tuple[int, ...] = ()
    before: int = 0
    few: bool = False
    bins: int = 0

    @property
    def width(self) -> int:
        return (self.hi - self.lo) // self.bins + 1


def _of_node(values: dict[int, int], shards: int) -> Column:
    """A row's value by its node, from an array literal of one number for each shard; 0 for nodes without one."""
    return F.element_at(F.lit(np.array([values.get(n, 0) for n in range(shards)], dtype=np.int64)), F.col("node") + 1)


def _routed(points: DataFrame, level: list[Node], shards: int) -> DataFrame:
    """``points`` with ``node`` moved one level down."""
    cut = [_of_node({n.first: n.cut[k] for n in level}, shards) for k in range(3)]
    at = F.element_at("v", _of_node({n.first: n.dim for n in level}, shards).cast("int") + 1)
    beyond = (at > cut[0]) | ((at == cut[0]) & ((F.col("content") > cut[1]) | ((F.col("content") == cut[1]) & (F.col("tie") >= cut[2]))))
    right = _of_node({n.first: n.first + n.shards // 2 for n in level}, shards)
    moved = F.when((right > 0) & beyond, right.cast("int")).otherwise(F.col("node"))
    return points.withColumn("node", moved)


def _within(points: DataFrame, searches: list[Search], shards: int) -> DataFrame:
    """Rows where a search still looks: its ``node``, the row's keys ``k0, content, tie``, and its ``bin``."""
    of = lambda value: _of_node({s.node.first: value(s) for s in searches}, shards)
    depth = of(lambda s: len(s.fixed))
    k0 = F.element_at("v", of(lambda s: s.node.dim).cast("int") + 1)
    key = F.when(depth == 0, k0).when(depth == 1, F.col("content")).otherwise(F.col("tie"))
    fixed = [of(lambda s, k=k: (*s.fixed, 0, 0)[k]) for k in (0, 1)]
    inside = ((depth == 0) | (k0 == fixed[0])) & ((depth < 2) | (F.col("content") == fixed[1])) & key.between(of(lambda s: s.lo), of(lambda s: s.hi))
    # Bins only where a search is: other nodes have no width.
    found = points.where(of(lambda s: 1) == 1).where(inside)
    width, past = of(lambda s: s.width), key - of(lambda s: s.lo)
    bin_of = F.round((past - F.pmod(past, width)) / width).cast("int")  # whole numbers of up to 62 bits
    return found.select("node", "weight", k0.alias("k0"), "content", "tie", bin_of.alias("bin"))


def _narrow(points: DataFrame, searches: list[Search], limits: list[tuple[int, int]], shards: int) -> None:
    """One histogram round for searches that still have many rows; ``limits``: ends of content and tie."""
    for s in searches:
        s.bins = max(LEAST_BINS, SUMS // len(searches))
    bins: dict[int, list] = {}
    for n, b, weight, rows in _within(points, searches, shards).groupBy("node", "bin").agg(F.sum("weight"), F.count("*")).collect():
        bins.setdefault(n, []).append((b, weight, rows))
    for s in searches:
        own = sorted(bins[s.node.first])
        for b, weight, rows in own:
            if s.before + weight >= s.target or b == own[-1][0]:
                lo = s.lo + b * s.width
                s.lo, s.hi, s.few = lo, min(s.hi, lo + s.width - 1), rows <= s.bins
                break
            s.before += weight
        if not s.few and s.lo == s.hi:
            if len(s.fixed) == 2:
                s.few = True  # rows alike in all keys: they stay together
            else:
                s.lo, s.hi, s.fixed = *limits[len(s.fixed)], (*s.fixed, s.lo)


def _decide(points: DataFrame, searches: list[Search], tolerance: float, shards: int) -> None:
    """Order the few rows that each search has left, and put its cut nearest to the target."""
    rows: dict[int, list] = {}
    # Rows alike in all keys are one sum: at most SUMS, or LEAST_BINS a node.
    for n, *key, weight in _within(points, searches, shards).groupBy("node", "k0", "content", "tie").agg(F.sum("weight")).collect():
        rows.setdefault(n, []).append((tuple(key), weight))
    for s in searches:
        at, cuts, last = s.before, [], None
        for key, weight in sorted(rows[s.node.first]):
            # A cut before this row parts no copies if the row before has another text; below the second key nothing is known of it.
            cuts.append((at, key[:2] != last[:2] if last else len(s.fixed) < 2, key))
            at, last = at + weight, key
        cuts.append((at, len(s.fixed) < 2, (*last[:2], last[2] + 1)))
        whole = [c for c in cuts if c[1] and abs(c[0] - s.target) <= tolerance]
        s.node.cut = min(whole or cuts, key=lambda c: (abs(c[0] - s.target), c[2]))[2]


def kd_shards(points: DataFrame, dims: int, shards: int) -> DataFrame:
    """``points`` with ``node``, the shard of each row. Columns: ``weight``, ``v`` (array of ``dims`` longs), ``content``, ``tie``; none null."""
    points = stage(points.withColumn("node", F.lit(0)))
    level, whole, total = [Node(0, shards)] if shards > 1 else [], None, 0
    names = [*[F.element_at("v", i + 1) for i in range(dims)], F.col("content"), F.col("tie")]
    while level:
        ends = [f(c) for c in names for f in (F.min, F.max)]
        stats = {r[0]: r for r in points.where(F.col("node").isin([n.first for n in level])).groupBy("node").agg(F.sum("weight"), *ends).collect()}  # a row a node
        searches = []
        for n in level:
            if n.first not in stats:
                continue
            _, weight, *flat = stats[n.first]
            ranges = list(zip(flat[::2], flat[1::2], strict=True))
            whole, total = whole or ranges, total or weight
            n.dim = max(range(dims), key=lambda d: (ranges[d][1] - ranges[d][0]) / max(1, whole[d][1] - whole[d][0]))
            searches.append(Search(n, weight * (n.shards // 2) / n.shards, *ranges[n.dim]))
        if not searches:
            break
        while todo := [s for s in searches if not s.few]:
            _narrow(points, todo, whole[-2:], shards)
        _decide(points, searches, TOLERANCE * total / shards, shards)
        before, points = points, stage(_routed(points, [s.node for s in searches], shards))
        discard(before)
        level = [k for s in searches for k in s.node.kids() if k.shards > 1]
    return points


#: What rows of equal text have in common.
GROUPED = ["text", "size", "crc"]


def text_points(rows: DataFrame, dims: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their ``part``, and the points of the tree: one for each text, or for each part of a text whose copies weigh too much together."""
    least = [F.min(F.element_at("v", i + 1)).alias(f"v{i}") for i in range(dims)]
    groups = stage(rows.groupBy(*GROUPED).agg(F.count("*").alias("n"), *least))
    total, largest = groups.agg(F.sum(F.col("n") * F.col("size")), F.max("size")).first()
    limit = max(GROUP * (total or 0) / shards, largest or 0)
    parts = F.ceil(F.col("n") * F.col("size") / F.lit(float(limit or 1)))
    heavy = groups.where(parts > 1).select(*GROUPED, parts.alias("parts"), *[f"v{i}" for i in range(dims)])  # at most shards / GROUP rows
    # Copies are dealt by their number; what isn't heavy is one part.
    dealt = rows.join(F.broadcast(heavy.select(*GROUPED, "parts")), GROUPED, "left")
    dealt = dealt.withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("row"), "parts")).otherwise(0)).drop("parts")
    halves = dealt.join(F.broadcast(heavy), GROUPED).groupBy(*GROUPED, "part", *[f"v{i}" for i in range(dims)]).agg(F.count("*").alias("n"))
    single = groups.where(parts <= 1).withColumn("part", F.lit(0).cast("long"))
    both = single.unionByName(halves)
    weight, tie = F.col("n") * F.col("size"), F.xxhash64(*GROUPED, "part").bitwiseAND(F.lit((1 << 50) - 1))
    # Of points alike in a dimension the heavy come first, so that cuts among them fall between light ones.
    heavy_first = -F.shiftleft(F.least(weight, F.lit(1 << 40)), 20) + F.pmod(tie, F.lit(1 << 20))
    points = both.select(*GROUPED, "part", weight.alias("weight"), F.array(*[f"v{i}" for i in range(dims)]).alias("v"), heavy_first.alias("content"), tie.alias("tie"))
    return dealt, points


def shard_documents(docs: DataFrame, shards: int, metadata: tuple[str, ...] = ("lang", "source"), overhead: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``size`` (bytes of the text plus ``overhead``), ``text_crc32``, ``shard`` and ``slot`` of each row.

    The tree's dimensions are the size and the columns in ``metadata``: numbers by value, anything else by the crc32 of its text.
    """
    kinds = dict(docs.dtypes)
    numbers = ("tinyint", "smallint", "int", "bigint")
    near = lambda c: F.greatest(F.least(c, F.lit(FAR)), F.lit(-FAR))
    coded = [F.coalesce(near(F.col(c).cast("long")) if kinds[c] in numbers else F.crc32(F.col(c).cast("string").cast("binary")), F.lit(0)) for c in metadata]
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead
    content = F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0))
    rows = docs.select(F.col(key).alias("id"), size.alias("size"), content.alias("crc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text"), F.array(*coded, size).alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = stage(rows)  # written, so the numbers stay
    rows, points = text_points(rows, len(coded) + 1, shards)
    placed = kd_shards(points, len(coded) + 1, shards).select(*GROUPED, "part", "node")
    placed = rows.join(placed, [*GROUPED, "part"])
    bucket = F.pmod(F.xxhash64("row"), F.lit(SLOT_BUCKETS))
    placed = placed.select("id", "size", "crc", "row", F.col("node").alias("shard"), bucket.alias("bucket"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "bucket").count()
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row"))
    # shards x SLOT_BUCKETS rows at most
    ranked = placed.withColumn("rank", rank).join(F.broadcast(starts), ["shard", "bucket"])
    slot = F.col("start") + F.col("rank") - 1
    return ranked.select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", slot.alias("slot"))
