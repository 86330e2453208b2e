"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Equal vectors of a label are first made one, with their count; rows are known by a 128-bit hash of the vector from then on. On a bounded sample
rotations of the principal components are learnt by alternating between signs and the orthogonal Procrustes solution, so that codes are balanced and
lose little. A code is cut into substrings, one for each Hamming table; a table's buckets hold the vectors of a label with one substring. Substrings
grow with the logarithm of the rows, so buckets of unlike vectors stay small, and tables with them, so that a pair at the threshold is missed by all
tables with a probability of at most ``MISSED``: every pair whose codes differ in fewer bits than there are tables is found, and most others.

Buckets are compared with the original vectors, in double precision and whole: a bucket is dealt out in pairs of blocks, each a
matrix product. A pair counts in the first table that holds it, which its codes tell, so nothing is listed by pairs: a block gives for
each vector the number of its links and a vector that it is joined with. A bucket with the same members as one of an earlier
table is left out, as all its pairs count there. What blocks join gives the classes.

Special cases: vectors that are null, empty, zero, or hold null or non-finite components, and those with a null
label, have no links and are components of their own; vectors of different lengths have no link; repeated rows
link with each other; a component is named by its least id (null, and every row kept, if it has none); rows with a null id count like
others; lengths of which the sample has few take random planes; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.batches import slices
from skein.operators.components import connected_components
from skein.stage import stage

THRESHOLD, MISSED = 0.98, 0.01
#: Distinct vectors that the rotations are learnt from, at most; rounds of learning; vectors of one length that they take at least.
SAMPLE, ROUNDS, LEAST_SAMPLE = 8000, 30, 64
#: Bits of a substring beyond log2 of a label's vectors; its least and most.
SPARE, NARROW, WIDE = 3, 8, 60
#: Vectors in a block, and rows of it that are multiplied at once.
BLOCK, STRIP = 4096, 512


def usable(vector: str = "embedding", label: str = "label") -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(label).isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn_rotation(sample: np.ndarray, seed: int) -> np.ndarray:
    """Projection (dimensions x dimensions) of iterative quantisation.

    Vectors aren't centred: links are angles about the origin, and bits of planes through it differ in proportion to the angle however narrow the data.
    """
    rng = np.random.default_rng(seed)
    _, _, axes = np.linalg.svd(sample.T @ sample)
    v = sample @ axes.T
    rotation = np.linalg.qr(rng.normal(0, 1, (len(axes), len(axes))))[0]
    for _ in range(ROUNDS):
        u, _, w = np.linalg.svd(np.sign(v @ rotation).T @ v)
        rotation = (u @ w).T
    return axes.T @ rotation


def tables_for(rows: int, threshold: float) -> tuple[int, int]:
    """Bits of a substring for labels of up to ``rows`` vectors, and number of tables."""
    width = min(WIDE, max(NARROW, math.ceil(math.log2(rows + 1)) + SPARE))
    differ = math.acos(min(1.0, max(-1.0, threshold))) / math.pi  # of a bit, at the threshold
    return width, max(1, math.ceil(math.log(MISSED) / math.log(1 - (1 - differ) ** width)))


class Coder:
    """Substrings of vectors' codes. Lengths that the sample has enough of take learnt rotations, one after the other until there are bits enough."""

    def __init__(self, sample: list[list[float]], width: int, tables: int):
        self.width, self.tables = width, tables
        by_size: dict[int, list] = {}
        for v in sample:
            by_size.setdefault(len(v), []).append(v)
        self.learnt = {}
        for size, own in by_size.items():
            if len(own) >= LEAST_SAMPLE:
                x = _unit(np.array(own, np.float64))
                self.learnt[size] = np.concatenate([learn_rotation(x, seed) for seed in range(-(-width * tables // size))], axis=1)[:, : width * tables]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        size = x.shape[1]
        planes = self.learnt.get(size)
        if planes is None:
            planes = np.random.default_rng(size).normal(0, 1, (size, self.width * self.tables))
        bits = (_unit(x) @ planes > 0).reshape(len(x), self.tables, self.width)
        return bits @ (np.int64(1) << np.arange(self.width, dtype=np.int64))


def _codes(nodes: DataFrame, coder: Coder) -> DataFrame:
    """``node, label, size, subs`` (a substring for each table)."""
    schema = T.StructType([nodes.schema["node"], nodes.schema["label"], T.StructField("size", T.IntegerType()), T.StructField("subs", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes = batch.column("size").to_numpy()
            out = np.zeros((batch.num_rows, coder.tables), np.int64)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                out[own] = coder(batch.column("embedding").take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), size))
            subs = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * coder.tables), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "label", "size")), subs], names=schema.names)

    return nodes.select("node", "label", "size", "embedding").mapInArrow(run, schema)


def _buckets(codes: DataFrame) -> DataFrame:
    """``node, label, size, t, v, n``: members of all buckets of ``n`` > 1 that have pairs which no earlier table holds for certain."""
    rows = codes.select("node", "label", "size", F.posexplode("subs").alias("t", "v"))
    key = ["label", "size", "t", "v"]
    members = [F.bit_xor(F.xxhash64("node")).alias("m1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("m2")]
    several = rows.groupBy(*key).agg(F.count("*").alias("n"), *members).where("n > 1")
    first = several.groupBy("m1", "m2", "n").agg(F.min(F.struct("t", "label", "size", "v")).alias("k"))
    return rows.join(first.select("k.*", "n"), key)


def compare(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray, ny: np.ndarray, t: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``x`` and ``y`` (unit vectors) reach the threshold, and for each ``x`` the rows (``ny``) that do for the first time in table ``t``."""
    near = np.zeros((len(x), len(y)), bool)
    counts = np.zeros(len(x), np.int64)
    for at in range(0, len(x), STRIP):
        strip = x[at : at + STRIP] @ y.T >= threshold
        near[at : at + STRIP] = strip
        fresh = strip
        if strip.any():
            for u in range(t):
                fresh = fresh & (sx[at : at + STRIP, u, None] != sy[None, :, u])
        counts[at : at + STRIP] = fresh @ ny
    return near, counts


def spread(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least joined position (``x`` first, then ``y``) of each ``x`` and ``y`` in the graph of ``near``."""
    n = len(near)
    x, y = np.arange(n), np.arange(n, n + near.shape[1])
    while True:
        new_y, new_x = y.copy(), x.copy()
        for at in range(0, n, STRIP):
            strip = near[at : at + STRIP]
            new_y = np.minimum(new_y, np.where(strip, x[at : at + STRIP, None], n + len(y)).min(axis=0, initial=n + len(y)))
        for at in range(0, n, STRIP):
            new_x[at : at + STRIP] = np.minimum(x[at : at + STRIP], np.where(near[at : at + STRIP], new_y, n + len(y)).min(axis=1, initial=n + len(y)))
        if (new_x == x).all() and (new_y == y).all():
            return x, y
        x, y = new_x, new_y


def _links(members: DataFrame, nodes: DataFrame, codes: DataFrame, threshold: float) -> DataFrame:
    """``a, b, m``: vector ``a`` has ``m`` links to rows not yet counted elsewhere, and is joined with ``b``."""
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCK).cast("int") - 1))
    dealt = members.select("label", "size", "t", "v", "node", block.alias("block"), others.alias("other"))
    pairs = dealt.select("label", "size", "t", "v", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block")
    key = ["label", "size", "t", "v", "i", "j"]
    whole = pairs.join(nodes.select("node", F.col("n").alias("rows"), "embedding"), "node").join(codes.select("node", "subs"), "node")
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("a", "b", "m")])

    def solve(group: list[tuple], t: int) -> pa.RecordBatch:
        ids, blocks, rows, vectors, subs = (np.concatenate(c) for c in zip(*group, strict=True))
        at = [np.flatnonzero(blocks == b) for b in np.unique(blocks)]
        x, s = _unit(vectors), subs
        if len(at) == 1:
            near, counts = compare(x, x, s, s, rows, t, threshold)
            if t == 0:  # a vector's own rows are counted apart
                counts -= rows * near.diagonal()
            np.fill_diagonal(near, True)
            out = (ids, ids[spread(near)[0]], counts, near.sum(axis=1) > 1)
        else:
            p, q = at
            near, from_p = compare(x[p], x[q], s[p], s[q], rows[q], t, threshold)
            _, from_q = compare(x[q], x[p], s[q], s[p], rows[p], t, threshold)
            joined = np.concatenate(spread(near))
            both = np.concatenate([ids[p], ids[q]])
            out = (both, both[joined], np.concatenate([from_p, from_q]), np.concatenate([near.any(axis=1), near.any(axis=0)]))
        keep = out[3]
        return pa.RecordBatch.from_arrays([pa.array(c[keep].astype(np.int64)) for c in out[:3]], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in slices(batches):
            keys = list(zip(*(batch.column(c).to_pylist() for c in key), strict=True))
            starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if keys[a] != now and held:
                    yield solve(held, now[2])
                    held = []
                now = keys[a]
                part = batch.slice(a, b - a)
                wide = [part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1) for c in ("embedding", "subs")]
                held.append((*(part.column(c).to_numpy() for c in ("node", "block", "rows")), *wide))
        if held:
            yield solve(held, now[2])

    rows = whole.repartition(*key).sortWithinPartitions(*key, "node").select(*key, "node", "block", "rows", "embedding", "subs")
    return rows.mapInArrow(run, schema)


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``key``, ``n_links`` (other rows linked directly), ``component_id`` and ``kept`` of each row."""
    rows = rows.select(F.col(key).alias("id"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    hashes = [F.when(usable(), h).alias(n) for n, h in (("h1", F.xxhash64("embedding")), ("h2", F.xxhash64(F.lit(1), "embedding")))]
    rows = rows.select("id", "label", *hashes, "embedding")
    one = rows.where("h1 is not null").groupBy("label", "h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    nodes = stage(one.withColumn("size", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()))  # written, so the numbers stay
    sample = [r[0] for r in nodes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("embedding").collect()]
    most = nodes.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 0
    codes = stage(_codes(nodes, Coder(sample, *tables_for(most, threshold))))
    links = stage(_links(_buckets(codes), nodes, codes, threshold))
    counts = links.groupBy("a").agg(F.sum("m").alias("m")).withColumnRenamed("a", "node")
    joined = connected_components(links.select("a", "b"))
    least = nodes.select("node", "id").join(joined, "node").groupBy("component").agg(F.min("id").alias("least"))
    joined = joined.join(least, "component").select("node", "least")
    classes = nodes.select("node", "label", "h1", "h2", "n", "id").join(counts, "node", "left").join(joined, "node", "left")
    classes = classes.select("label", "h1", "h2", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    # Rows find their class by the vector's hash; unusable ones find none.
    placed = rows.select("id", "label", "h1", "h2").join(classes, ["label", "h1", "h2"], "left")
    named = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = placed.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), named.alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", key)
