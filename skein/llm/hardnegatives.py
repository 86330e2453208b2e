"""Hard negatives of anchors among all vectors, by a pivot table.

An anchor's positives are the rows of its label with the greatest inner products; its hard negatives for a positive are the best rows of other labels
whose score lies between a share of the positive's score and that score itself. Both are searches for the greatest inner product in a window.

Vectors get one more component, ``sqrt(M**2 - |x|**2)`` with ``M`` the greatest length (anchors: 0), so that all rows have the length ``M`` and an inner product falls as the Euclidean distance
grows: ``q.x = (|q|**2 + M**2 - d(q, x)**2) / 2``. Each row's distances to a few pivots, chosen far apart from a bounded sample, are stored with it. By the triangle inequality ``|d(q, p) - d(x, p)| <= d(q, x) <= d(q, p) + d(x, p)``
they bracket the score of any pair. Rows are dealt by hash into blocks; a block orders its rows by label, nearest pivot and distance to it and cuts them into tiles, each with the range of its distances.
An anchor passes by tiles whose bracket misses its windows or stays under the scores found so far, then rows for the same reason, and the exact integer product is taken of what survives. Every anchor meets every block (the anchors are a
stated set of queries), a block sends at most as many rows for each window as are wanted, and the best of all blocks are kept. Brackets allow for rounding, so the result is exact.

In many dimensions distances differ little and brackets are wide, so that much survives: what the pivots save depends on the data; the result doesn't.

Special cases: rows with a null label, a null vector, or a component that is null, not finite or over ``2**23`` in size take no part; rows only meet rows of the same number of components; a repeated row is a row of
its own, other than itself; equal scores go by the smaller id, null ids last; an anchor without positives, or a positive without negatives, has no rows, and
fewer than wanted are all returned; a negative positive score has an empty window; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.llm.batches import slices
from skein.stage import stage

#: Positives of an anchor, negatives of a positive; a negative's least share of the positive's score, in hundredths.
POSITIVES, NEGATIVES, SHARE = 5, 5, 80
#: Pivots of a length of vectors; rows that they are chosen from, at most.
PIVOTS, SAMPLE = 8, 2048
#: Rows of a block at least and at most, and blocks from which on they are larger; rows of a tile; anchors that meet a block at once.
LEAST_BLOCK, MOST_BLOCK, BLOCKS, TILE, TOGETHER = 1024, 16384, 64, 64, 256
#: Components beyond take no part, so that all scores are whole numbers of 64 bits; below the second bound floating-point products are exact.
MOST_COMPONENT, EXACT = 2**23, 2.0**53
#: Of the size of squared distances: what rounding can add to them.
ROUNDING = 1e-12
NONE, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def usable(vector: str, label: str) -> Column:
    return F.coalesce(F.col(label).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) <= MOST_COMPONENT)), F.lit(False))


def choose_pivots(sample: np.ndarray, most: float, n: int = PIVOTS) -> np.ndarray:
    """Up to ``n`` lengthened vectors of the sample, each the furthest from those before it."""
    x = lengthen(sample, most)
    chosen = [0]
    far = np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def lengthen(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with one more component that makes all of them ``most`` long."""
    return np.column_stack([x, np.sqrt(np.maximum(0, most**2 - (x**2).sum(axis=1)))])


@dataclass
class PivotTable:
    """Pivots for each number of components, and the greatest length of a vector."""

    most: float
    pivots: dict[int, np.ndarray]

    def of(self, size: int) -> np.ndarray:
        """A number of components that the sample has none of has one pivot, the lengthened origin."""
        return self.pivots.get(size, np.eye(1, size + 1, size) * self.most)

    def distances(self, lengthened: np.ndarray, size: int) -> np.ndarray:
        p = self.of(size)
        squares = (lengthened**2).sum(axis=1)[:, None] + (p**2).sum(axis=1) - 2 * lengthened @ p.T
        return np.sqrt(np.maximum(0, squares))

    def brackets(self, squares: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score for squared anchor lengths and distances of at least ``near`` and at most ``far``."""
        slack = 2 * np.sqrt(ROUNDING * (3 * self.most**2 + squares))
        low, high = np.maximum(0, near - slack), far + slack
        both = squares + self.most**2
        return (both - high**2) / 2, (both - low**2) / 2


class Block:
    """Rows of one number of components, ordered into tiles."""

    def __init__(self, table: PivotTable, size: int, rows: list[np.ndarray], vectors: np.ndarray, distances: np.ndarray):
        nodes, ids, labels = rows
        home = distances.argmin(axis=1)
        order = np.lexsort((distances[np.arange(len(home)), home], home, labels))
        cuts = np.flatnonzero(np.diff(labels[order], prepend=labels[order[0]] - 1, append=labels[order[-1]] + 1))
        tiles = [order[a:b] for low, high in zip(cuts[:-1], cuts[1:], strict=True) for a, b in ((k, min(k + TILE, high)) for k in range(low, high, TILE))]
        self.tiles = [t[np.lexsort((nodes[t], ids[t]))] for t in tiles]  # equal scores then stand in the order of ids
        self.labels = np.array([labels[t[0]] for t in tiles])
        self.nearest, self.furthest = (np.array([f(distances[t], axis=0) for t in tiles]) for f in (np.min, np.max))
        self.table, self.size, self.nodes, self.ids, self.vectors, self.distances = table, size, nodes, ids, vectors, distances
        self.longest = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)).max()
        self.looked_at = self.scored = 0

    def products(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        x = self.vectors[rows]
        if np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1)).max() * self.longest < EXACT:
            return (anchors.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
        return anchors @ x.T

    def search(self, anchors: np.ndarray, nodes: np.ndarray, labels: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``n`` best rows of the anchors' label, or of others, in each window: scores, ids and nodes (anchors x windows x n; ``NONE`` where there are fewer)."""
        shape = (*low.shape, n)
        best, ids, found = np.full(shape, NONE), np.full(shape, LAST), np.full(shape, LAST)
        squares = (anchors.astype(np.float64) ** 2).sum(axis=1)
        to_pivots = self.table.distances(np.column_stack([anchors.astype(np.float64), np.zeros(len(anchors))]), self.size)
        gaps = np.maximum(to_pivots[:, None] - self.furthest, self.nearest - to_pivots[:, None]).max(axis=2)
        least, greatest = self.table.brackets(squares[:, None], gaps, (to_pivots[:, None] + self.furthest).min(axis=2))
        right = (labels[:, None] == self.labels) == same
        for k in np.argsort(-np.where(right, greatest, -np.inf).max(axis=0, initial=-np.inf), kind="stable"):
            floor = np.maximum(low, best[:, :, -1])
            a = np.flatnonzero(right[:, k] & ((greatest[:, k, None] >= floor) & (least[:, k, None] <= high)).any(axis=1))
            if not len(a):
                continue
            rows = self.tiles[k]
            d = self.distances[rows]
            gap, reach = np.zeros((len(a), len(rows))), np.full((len(a), len(rows)), np.inf)
            for p in range(d.shape[1]):
                np.maximum(gap, np.abs(to_pivots[a, None, p] - d[None, :, p]), out=gap)
                np.minimum(reach, to_pivots[a, None, p] + d[None, :, p], out=reach)
            worst, top = self.table.brackets(squares[a, None], gap, reach)
            alive = np.zeros(gap.shape, bool)
            for w in range(low.shape[1]):
                alive |= (top >= floor[a, None, w]) & (worst <= high[a, None, w])
            alive &= self.nodes[rows] != nodes[a, None]
            cols, keep = np.flatnonzero(alive.any(axis=0)), alive.any(axis=1)
            self.looked_at += alive.size
            if not len(cols):
                continue
            a, rows, alive = a[keep], rows[cols], alive[np.ix_(keep, cols)]
            self.scored += alive.sum()
            scores = self.products(anchors[a], rows)
            for w in range(low.shape[1]):
                fits = alive & (scores >= floor[a, None, w]) & (scores <= high[a, None, w])
                some = np.flatnonzero(fits.any(axis=1))
                if len(some):
                    these = np.where(fits[some], scores[some], NONE)
                    first = np.argsort(np.invert(these), axis=1, kind="stable")[:, :n]
                    at = a[some]
                    new = np.take_along_axis(these, first, axis=1)
                    real = new != NONE
                    all_scores = np.concatenate([best[at, w], new], axis=1)
                    all_ids = np.concatenate([ids[at, w], np.where(real, self.ids[rows][first], LAST)], axis=1)
                    all_nodes = np.concatenate([found[at, w], np.where(real, self.nodes[rows][first], LAST)], axis=1)
                    order = np.lexsort((all_nodes, all_ids, np.invert(all_scores)), axis=-1)[:, :n]
                    best[at, w], ids[at, w], found[at, w] = (np.take_along_axis(x, order, axis=1) for x in (all_scores, all_ids, all_nodes))
        return best, ids, found


def _search(nodes: DataFrame, anchors: DataFrame, blocks: int, table: PivotTable, same: bool, n: int) -> DataFrame:
    """``anchor, window, id, node, score``: the best rows of each block in each window (``low``, ``high``) of each anchor."""
    none = F.array().cast("array<long>")
    dealt = nodes.select(F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"), "size", F.lit(0).alias("kind"), "node", "id", "label", "vector", "distances", none.alias("low"), none.alias("high"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "size", F.lit(1).alias("kind"), "node", "id", "label", "vector", F.array().cast("array<double>").alias("distances"), "low", "high")
    rows = dealt.unionByName(asked).repartition("block", "size").sortWithinPartitions("block", "size", "kind", "node")
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("window", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("id", "node", "score"))])

    def wide(part: pa.RecordBatch, column: str) -> np.ndarray:
        values = part.column(column).flatten().to_numpy(zero_copy_only=False)
        return values.reshape(part.num_rows, len(values) // part.num_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in slices(batches, TOGETHER):
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("block", "size", "kind")])
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                part, (number, size, kind) = batch.slice(a, b - a), keys[a].tolist()
                if (number, size) != now:
                    now, held, block = (number, size), [], None
                own = [part.column(c).to_numpy() for c in ("node", "id", "label")]
                vectors = wide(part, "vector").astype(np.int64)
                if kind == 0:
                    held.append((*own, vectors, wide(part, "distances")))
                elif held or block:
                    if block is None:
                        *rows, x, d = (np.concatenate(c) for c in zip(*held, strict=True))
                        block, held = Block(table, size, rows, x, d), []
                    best, ids, found = block.search(vectors, own[0], own[2], same, wide(part, "low"), wide(part, "high"), n)
                    at = np.nonzero(best != NONE)
                    out = (own[0][at[0]], at[1].astype(np.int32), ids[at], found[at], best[at])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=schema.names)

    return rows.mapInArrow(run, schema)


def _first(found: DataFrame, n: int) -> DataFrame:
    """The ``n`` best of all blocks in each window, with their ``rank`` from 1."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "node")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, share: int = SHARE, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score`` for the rows that ``anchors`` (a condition on the key) picks; components are whole numbers."""
    kind = rows.schema[label].dataType
    same = F.col(label).cast("long") if isinstance(kind, (T.IntegralType, T.BooleanType)) else F.xxhash64(label)
    taken = rows.where(usable(vector, label)).select(
        F.coalesce(F.col(key).cast("long"), F.lit(int(LAST))).alias("id"), same.alias("label"), F.size(vector).alias("size"), F.col(vector).cast("array<int>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("asks")
    )
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    n, longest = taken.agg(F.count("*"), F.max(square)).first()
    sample = [r[0] for r in taken.orderBy(F.xxhash64("vector")).limit(SAMPLE).select("vector").collect()]
    most = float(np.sqrt(longest or 0.0))
    by_size: dict[int, list] = {}
    for v in sample:
        by_size.setdefault(len(v), []).append(v)
    table = PivotTable(most, {s: choose_pivots(np.array(own, np.float64).reshape(len(own), s), most) for s, own in by_size.items()})
    blocks = max(1, -(-n // min(MOST_BLOCK, max(LEAST_BLOCK, n // BLOCKS))))
    numbered = taken.withColumn("node", F.monotonically_increasing_id())
    schema = T.StructType([*numbered.schema.fields, T.StructField("distances", T.ArrayType(T.DoubleType()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list = [None] * batch.num_rows
            length = batch.column("size").to_numpy()
            for s in np.unique(length).tolist():
                at = np.flatnonzero(length == s)
                x = batch.column("vector").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), s)
                for k, d in zip(at.tolist(), table.distances(lengthen(x.astype(np.float64), most), s), strict=True):
                    out[k] = d
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=schema.names)

    nodes = stage(numbered.mapInArrow(measure, schema))  # written, so the numbers stay
    asking = nodes.where("asks")
    everything = [F.array(F.lit(int(v)).cast("long")).alias(c) for c, v in (("low", NONE + 1), ("high", LAST))]
    close = stage(_first(_search(nodes, asking.select("*", *everything), blocks, table, True, positives), positives))
    bound = F.ceil(F.col("score").cast("decimal(38,0)") * share / 100).cast("long")
    windows = close.groupBy(F.col("anchor").alias("node")).agg(F.sort_array(F.collect_list(F.struct("rank", "score", bound.alias("low")))).alias("w"))  # at most the wanted positives
    # A window that is missing, or that of a negative score, is empty: its least score is over its greatest.
    pad = lambda field, missing: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("w", i)[field], F.lit(missing)))
    asked = asking.join(windows, "node").select("node", "id", "label", "size", "vector", pad("low", int(LAST)).alias("low"), pad("score", int(NONE + 1)).alias("high"))
    hard = _first(_search(nodes, asked, blocks, table, False, negatives), negatives)
    real = lambda c: F.when(F.col(c) != int(LAST), F.col(c))
    sides = close.join(asking.select(F.col("node").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").select("anchor", (F.col("rank") - 1).alias("window"), "anchor_id", real("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.select("anchor", "window", "rank", real("id").alias("negative_id"), F.col("score").alias("negative_score")).join(sides, ["anchor", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
