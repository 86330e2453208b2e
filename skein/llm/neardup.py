"""Near-duplicate classes by consistent weighted sampling of TF-IDF shingles.

A text's features are its shingles of five words (one shorter one, for a text of fewer words), each weighing its count times
its IDF, 1 + ln((N + 1) / (df + 1)). So texts are similar as far as they share what is rare; what many texts share counts little.
Copies must not make their own words common: every row is counted, in N and in df, but n rows with one least shingle hash (which near copies
mostly share) count 1 / n each, so that together they count once. Frequencies are held in a count-min sketch whose width grows with the corpus from
2**18 to 2**22 cells, less the mean load of a cell; with D shingles in W cells a frequency is off by some sqrt(D / W), so only what is commoner than that is
weighted down.

Improved consistent weighted sampling draws ``BANDS`` x ``ROWS`` samples, two of which agree with the probability of the weighted
Jaccard similarity; texts that agree on a whole band share a bucket and are candidates (at similarity 0.8 with probability 0.9998).
Texts with equal words are one node from the start. Links are verified by exact weighted Jaccard similarity of whole texts. First each
bucket's nodes are compared with one of them, ``STARS`` times with different ones; this is linear and joins most copies. Buckets that still hold several components are
compared in full: every pair of nodes of different components, unless the total weights rule the threshold out. There the largest component of a bucket
is only compared with the others, never with itself, and large buckets are dealt out in pairs of blocks. The links' components are the classes.

A row is known by a 128-bit hash of id and text, so rows of one id with different texts are different rows.

Special cases: null and empty texts, and others without words, are alone in their classes; texts of any length are read whole; repeated
rows are in one class; a class is named by its least id (null if it has none), and the row with that id is kept (of several texts with that id the one
with the least hash; rows alike in id and text are all marked as kept); an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.batches import map_texts, slices, texts_of
from skein.operators.components import connected_components
from skein.stage import discard, owned, stage

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: The sketch: rows, least and greatest bits of a row's width, bytes of text for which there is one cell, parts in which it is summed.
SKETCH_DEPTH, LEAST_BITS, MOST_BITS, CELL_BYTES, SKETCH_PARTS = 2, 18, 22, 3200, 64
#: What a row counts in the sketch if no other has its least shingle hash: shares are whole numbers, so their sums don't depend on the order.
WHOLE = 1 << 24
STARS = 2
#: Nodes, and bytes of their texts, in a block of a bucket that is compared in full.
BLOCK, BLOCK_BYTES = 1500, 32 << 20
TABLE_WORDS = 500_000
#: Shingles that are sampled together.
CACHED = 1 << 16

_words = re.compile(r"\w+").findall
_U = np.uint64


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


class WordHashes(dict):
    """Numbers of the words asked for, in ``hashes`` their hashes (small numbers are much quicker to gather)."""

    def __init__(self):
        self.hashes = array("Q")

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return number

    def __call__(self, texts: list[list[str]], words: int) -> np.ndarray:
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int32, words)
        return np.frombuffer(self.hashes, np.uint64)[numbers] if words else np.zeros(0, np.uint64)


class Shingler:
    """Shingles of a batch of texts; keeps a bounded table of word hashes."""

    def __init__(self):
        self.hashes = WordHashes()
        self.mix = _odd(SHINGLE, 11)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Of all texts in turn: distinct shingles and their counts; where each text's begin (with the end); each text's digest (empty without words)."""
        split = [_words(t.lower()) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        if len(self.hashes) > TABLE_WORDS:
            self.hashes = WordHashes()
        codes = self.hashes(split, int(sizes.sum()))
        ends = np.cumsum(sizes)
        digests = [xxhash.xxh128_digest(codes[e - n : e].tobytes()) if n else b"" for e, n in zip(ends, sizes, strict=True)]
        # A text's last four positions see words of the next; those sums are left out, or, in a text of fewer words, replaced.
        padded = np.append(codes, np.zeros(SHINGLE, np.uint64))
        sums = np.zeros(len(codes), np.uint64)
        for j in range(SHINGLE):
            sums += padded[j : j + len(codes)] * self.mix[j]
        sums ^= sums >> _U(31)
        sums *= _U(0x9E3779B97F4A7C15)
        owner = np.repeat(np.arange(len(texts)), sizes)
        left = np.repeat(ends, sizes) - np.arange(len(codes))
        short = sizes[owner] < SHINGLE
        whole = (left >= SHINGLE) | (short & (left == sizes[owner]))
        for i in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)):
            sums[ends[i] - sizes[i]] = xxhash.xxh64_intdigest(digests[i])
        # Distinct shingles by text: 16 bits for the text (a batch has fewer), 48 for the shingle.
        keys = np.sort((owner[whole].astype(np.uint64) << _U(48)) | (sums[whole] >> _U(16)))
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        starts = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << _U(48))
        return (keys & _U((1 << 48) - 1)) * _U(0x9E3779B97F4A7C15), counts, starts, digests


def _cells(shingles: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([(shingles * m) >> _U(64 - bits) for m in _odd(SKETCH_DEPTH, 13)]).astype(np.int64)


class Weights:
    """Shingle weights from the sketch of document frequencies (``SKETCH_DEPTH`` rows of 2**bits cells)."""

    def __init__(self, sketch: np.ndarray, docs: int, noise: float):
        self.sketch, self.docs, self.noise = sketch, docs, noise
        self.bits = int(sketch.shape[1]).bit_length() - 1

    def __call__(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        cells = _cells(shingles, self.bits)
        df = np.minimum.reduce([self.sketch[d][cells[d]] for d in range(SKETCH_DEPTH)]) - self.noise
        idf = 1 + np.log((self.docs + 1) / (np.clip(df, 1, max(self.docs, 1)) + 1))
        return (counts * idf).astype(np.float32)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, text``, the row's 128-bit hash ``k1, k2``, and the text's ``size`` in bytes."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.select("id", "text", *_row_hash(F.col("id"), F.col("text")), F.octet_length("text").cast("long").alias("size"))


def _row_hash(row_id: Column, text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(row_id, text).alias("k1"), F.xxhash64(F.lit(1), row_id, text).alias("k2")]


def document_frequencies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Weights:
    """The sketch over all documents: each task sums its own, parts of them are summed by part, one array of bounded size comes back.

    One pass gives every row's least shingle hash and the sketch with every row counted whole; only rows that aren't alone with their least hash are read again,
    to take from the sketch what they count less. Shares are whole numbers, so this is the sum of the shares.
    """
    rows = _keyed(docs, key, text)
    held = rows.agg(F.sum("size")).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(held // CELL_BYTES).bit_length()))
    width, share = 1 << bits, SKETCH_DEPTH * (1 << bits) // SKETCH_PARTS
    counted = "part int, counts binary"

    def emit(parts: dict[int, np.ndarray]) -> list[pa.Array]:
        pack = zstandard.ZstdCompressor(level=1).compress
        return [pa.array(list(parts), pa.int32()), pa.array([pack(v.tobytes()) for v in parts.values()], pa.binary())]

    class Sums:
        """A task's sketch, and its sums of rows and of shingles."""

        def __init__(self):
            self.cells, self.totals = np.zeros((SKETCH_DEPTH, width), np.int64), np.zeros(2, np.int64)

        def add(self, found: np.ndarray, sizes: np.ndarray, each: np.ndarray) -> None:
            for row, cells in zip(self.cells, _cells(found, bits), strict=True):
                np.add.at(row, cells, np.repeat(each, sizes))
            self.totals += (each[sizes > 0].sum(), each @ sizes)

        def parts(self) -> list[pa.Array]:
            return emit({-1: self.totals, **dict(enumerate(self.cells.reshape(SKETCH_PARTS, share)))} if self.totals.any() else {})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sums, names = Shingler(), Sums(), ["k1", "k2", "least", "part", "counts"]
        for batch in slices(batches):
            found, _, starts, _ = shingler(texts_of(batch))
            sizes = np.diff(starts)
            sums.add(found, sizes, np.full(len(sizes), WHOLE))
            have = np.flatnonzero(sizes)
            least = np.minimum.reduceat(found, starts[have]).view(np.int64) if len(have) else np.zeros(0, np.int64)
            keys = [batch.column(k).take(pa.array(have)) for k in ("k1", "k2")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(least), pa.nulls(len(have), pa.int32()), pa.nulls(len(have), pa.binary())], names)
        parts = sums.parts()
        yield pa.RecordBatch.from_arrays([pa.nulls(len(parts[0]), pa.int64())] * 3 + parts, names)

    def less(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sums = Shingler(), Sums()
        for batch in slices(batches):
            found, _, starts, _ = shingler(texts_of(batch))
            sums.add(found, np.diff(starts), batch.column("less").to_numpy())
        yield pa.RecordBatch.from_arrays(sums.parts(), ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(unpack(counts), np.int64)
                parts[part] = parts[part] + values if part in parts else values
        yield pa.RecordBatch.from_arrays(emit(parts), ["part", "counts"])

    seen = stage(rows.select("k1", "k2", "text").mapInArrow(first, f"k1 long, k2 long, least long, {counted}"))
    sampled = seen.where("part is null").select("k1", "k2", "least")
    groups = sampled.groupBy("least").agg(F.count("*").alias("n")).where("n > 1")
    # Left to Spark, which sizes both sides.
    shared = sampled.join(groups, "least").select("k1", "k2", "n").dropDuplicates(["k1", "k2"])
    counts_less = F.greatest(F.lit(1), F.round(WHOLE / F.col("n"))).cast("long") - WHOLE
    again = rows.select("k1", "k2", "text").join(shared, ["k1", "k2"]).select("text", counts_less.alias("less")).mapInArrow(less, counted)
    sums = seen.where("part is not null").select("part", "counts").unionByName(again).repartition(SKETCH_PARTS, "part").mapInArrow(add, counted)
    unpack = zstandard.ZstdDecompressor().decompress
    found = {r["part"]: np.frombuffer(unpack(r["counts"]), np.int64) for r in sums.collect()}  # SKETCH_PARTS + 1 rows
    if not found:
        return Weights(np.zeros((SKETCH_DEPTH, width), np.float32), 0, 0.0)
    n, shingles = found.pop(-1)
    sketch = np.concatenate([found[i] for i in range(SKETCH_PARTS)]).reshape(SKETCH_DEPTH, width)
    return Weights((sketch / WHOLE).astype(np.float32), round(n / WHOLE), shingles / WHOLE / width)


class Sampler:
    """Improved consistent weighted sampling. The Gamma(2, 1) and uniform variables of (shingle, sample) are drawn from tables by hash."""

    def __init__(self):
        rng = np.random.default_rng(17)
        gamma = lambda: -np.log(rng.random(1 << 16) * rng.random(1 << 16) + 1e-30)
        self.r, self.log_c, self.beta = (x.astype(np.float32) for x in (gamma(), np.log(gamma()), rng.random(1 << 16)))
        self.over_r = 1 / self.r
        self.mix = _odd(SAMPLES, 19)

    def __call__(self, shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Texts x SAMPLES: hash of the drawn (shingle, level); 0 for texts without shingles."""
        out = np.zeros((len(starts) - 1, SAMPLES), np.uint64)
        have = np.flatnonzero(np.diff(starts))
        if not len(have):
            return out
        begin, sizes = starts[have], np.diff(starts)[have]
        log_s = np.log(weights)
        # A few texts at a time, so that what is computed for their shingles stays in the processor's cache.
        cuts = np.flatnonzero(np.diff(begin // CACHED, prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(have)), strict=True):
            lo, hi = begin[a], begin[b - 1] + sizes[b - 1]
            own, first, number, logs = shingles[lo:hi], begin[a:b] - lo, sizes[a:b], log_s[lo:hi]
            for k in range(SAMPLES):
                at = ((own * self.mix[k]) >> _U(48)).view(np.int64)
                beta = self.beta.take(at)
                level = self.over_r.take(at)
                level *= logs
                level += beta
                np.floor(level, out=level)
                beta -= level
                beta -= 1
                beta *= self.r.take(at)
                value = beta
                value += self.log_c.take(at)
                least = np.minimum.reduceat(value, first)
                hits = np.flatnonzero(value == np.repeat(least, number))
                hits = hits[np.searchsorted(hits, first)]
                out[have[a:b], k] = (own[hits] ^ (level[hits].astype(np.int64).astype(np.uint64) * _U(0xD6E8FEB86659FD93))) * self.mix[k]
        return out


def signatures(rows: DataFrame, weights: Weights, keys: tuple[str, ...] = ("id", "k1", "k2", "size")) -> DataFrame:
    """``keys``, ``digest`` (of the words; empty without), ``bands`` (a hash for each) and ``total`` (weight) of each row's ``text``."""

    def make():
        shingler, sampler = Shingler(), Sampler()
        mix = _odd(ROWS, 23)

        def run(texts: list[str]) -> list:
            shingles, counts, starts, digests = shingler(texts)
            w = weights(shingles, counts)
            drawn = sampler(shingles, w, starts)
            totals = np.diff(np.concatenate([[0.0], np.cumsum(w, dtype=np.float64)])[starts])
            bands = ((drawn.reshape(-1, BANDS, ROWS) * mix).sum(axis=2) ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            return [digests, pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel())), totals]

        return run

    out = [("digest", T.BinaryType(), pa.binary()), ("bands", T.ArrayType(T.LongType()), pa.list_(pa.int64())), ("total", T.DoubleType(), pa.float64())]
    return map_texts(rows, list(keys), out, make)


Features = tuple[np.ndarray, np.ndarray, float]


def features_of(texts: list[str], shingler: Shingler, weights: Weights) -> list[Features]:
    """Shingles (ascending), their weights, and the total weight of each text."""
    shingles, counts, starts, _ = shingler(texts)
    w = weights(shingles, counts)
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        order = np.argsort(shingles[a:b])
        out.append((shingles[a:b][order], w[a:b][order], float(w[a:b].sum(dtype=np.float64))))
    return out


def similarity(a: Features, b: Features) -> float:
    """Weighted Jaccard similarity of two texts."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    common = float(np.minimum(a[1][same], b[1][at[same]]).sum(dtype=np.float64))
    return common / (a[2] + b[2] - common)


def similar(a: Features, b: Features) -> bool:
    """Whether the similarity reaches the threshold; it is at most the lesser total weight over the greater (the last factor is for rounding)."""
    return min(a[2], b[2]) >= THRESHOLD * (1 - 1e-9) * max(a[2], b[2]) and similarity(a, b) >= THRESHOLD


def link_texts(nodes: list[int], components: list[int], features: list[Features], across: list[int] | None = None) -> list[tuple[int, int]]:
    """Verified links that join all components which candidate pairs join: all pairs, or only those of different ``across``."""
    root, links = {c: c for c in components}, []
    side = np.zeros(len(nodes), np.int64) if across is None else np.array(across)
    totals = np.array([f[2] for f in features])
    floor = THRESHOLD * (1 - 1e-9)

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for x in range(len(nodes) - 1):
        rest = np.arange(x + 1, len(nodes))
        if across is not None:
            rest = rest[side[rest] != side[x]]
        for y in rest[np.minimum(totals[rest], totals[x]) >= floor * np.maximum(totals[rest], totals[x])]:
            p, q = find(components[x]), find(components[y])
            if p != q and similarity(features[x], features[y]) >= THRESHOLD:
                root[p] = q
                links.append((nodes[x], nodes[y]))
    return links


_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _as_links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _blocks(nodes: Column, size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(nodes / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")


def _star_links(pairs: DataFrame, texts: DataFrame, weights: Weights) -> DataFrame:
    """Of ``pairs`` (``node``, ``hub``) those that are similar. A hub's text stands before its nodes', once in each block of them."""
    sized = pairs.join(pairs.groupBy("hub").agg(F.count("*").alias("n")), "hub")
    dealt = sized.select("hub", "node", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)).alias("block"))
    hubs = dealt.select("hub", F.col("hub").alias("node"), "block").distinct()
    both = dealt.select("*", F.lit(1).alias("at")).unionByName(hubs.select("*", F.lit(0).alias("at"))).join(texts.select("node", "text"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, hub, features = Shingler(), None, None
        for batch in slices(batches):
            links = []
            columns = (batch.column(c).to_pylist() for c in ("hub", "node"))
            for h, node, f in zip(*columns, features_of(texts_of(batch), shingler, weights), strict=True):
                if h == node:
                    hub, features = h, f
                elif h == hub and similar(features, f):
                    links.append((node, h))
            yield _as_links(links)

    return both.repartition("hub", "block").sortWithinPartitions("hub", "block", "at").select("hub", "node", "text").mapInArrow(run, _LINKS)


def _full_links(members: DataFrame, texts: DataFrame, weights: Weights) -> DataFrame:
    """Links between nodes of different components within buckets; ``members``: ``band, node, component, size``."""
    parts = members.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    most = F.max(F.struct("n", "size", "component"))
    buckets = parts.groupBy("band").agg(most.alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("most.n < n")
    few = _blocks(F.col("n"), F.col("size")) == 1
    outer = F.when(few, 1).otherwise(_blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")))
    inner = F.when(few, 0).otherwise(_blocks(F.col("most.n"), F.col("most.size")))
    buckets = buckets.select("band", F.when(~few, F.col("most.component")).alias("largest"), outer.alias("outer"), inner.alias("inner"))
    # Blocks 0 .. outer - 1 hold the other components, outer .. outer + inner - 1 the largest. Pairs of blocks: all but those within the largest.
    dealt = members.join(buckets, "band")
    is_largest = F.coalesce(F.col("component") == F.col("largest"), F.lit(False))
    block = F.when(is_largest, F.col("outer") + F.pmod(F.xxhash64("node"), F.col("inner"))).otherwise(F.pmod(F.xxhash64("node"), F.col("outer"))).cast("int")
    partners = F.when(is_largest, F.sequence(F.lit(0), F.col("outer") - 1)).otherwise(F.sequence(F.lit(0), F.col("outer") + F.col("inner") - 1))
    dealt = dealt.select("band", "node", "component", block.alias("block"), partners.alias("partners")).join(texts.select("node", "text"), "node")
    pairs = dealt.select("*", F.explode("partners").alias("other"))
    pairs = pairs.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "component", "block", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, now = Shingler(), [], None
        for batch in slices(batches):
            columns = (batch.column(c).to_pylist() for c in ("band", "i", "j", "node", "component", "block"))
            for row in zip(*columns, features_of(texts_of(batch), shingler, weights), strict=True):
                if row[:3] != now and held:
                    yield _as_links(solve(held))
                    held = []
                now = row[:3]
                held.append(row)
        if held:
            yield _as_links(solve(held))

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        nodes, components, blocks, features = (list(c) for c in zip(*(r[3:] for r in rows), strict=True))
        return link_texts(nodes, components, features, blocks if rows[0][1] != rows[0][2] else None)

    keys = ["band", "i", "j"]
    return pairs.repartition(*keys).sortWithinPartitions(*keys, "node").select(*keys, "node", "component", "block", "text").mapInArrow(run, _LINKS)


def _nodes(signed: DataFrame) -> DataFrame:
    """One row for each text (by its words): ``node``, ``digest``, ``bands`` and ``best`` (the row that stands for it)."""
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2", "size")).alias("best")
    texts = signed.where(F.length("digest") > 0).groupBy("digest").agg(best, F.first("bands").alias("bands"), F.max("total").alias("total"))
    return stage(texts.withColumn("node", F.monotonically_increasing_id()))  # written, so the numbers stay


def _classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, k1, k2, class_id, kept`` of each row."""
    rows = _keyed(docs, key, text)
    with owned():
        weights = document_frequencies(docs, key, text)
    signed = stage(signatures(rows, weights))
    nodes = _nodes(signed)
    buckets = nodes.select("node", "total", F.col("best.size").alias("size"), F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.count("*").alias("nodes")).where("nodes > 1")
    members = stage(buckets.join(shared, "band"))
    candidates = members.select("node").distinct().join(nodes.select("node", "best.k1", "best.k2"), "node")
    # One row of each candidate's text: rows alike in id and text are dropped after the join, when the other texts are gone.
    texts = stage(rows.select("k1", "k2", "text").join(candidates, ["k1", "k2"]).select("node", "text").dropDuplicates(["node"]))
    classes = members.select("node", F.col("node").alias("component")).distinct()
    for round_ in range(STARS + 1):
        now = members.join(classes, "node")
        if round_:
            now = now.where("nodes > 2")  # two nodes were compared with each other in the first round
        if round_ < STARS:
            # The hub is of the largest component in the bucket; nodes of other components are compared with it.
            pick = F.max(F.struct("n", F.xxhash64("component", F.lit(round_)).alias("h"), "hub", "component"))
            parts = now.groupBy("band", "component").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", F.lit(round_)).alias("h"), F.col("node").alias("hub"), "total")).alias("hub"))
            hubs = parts.groupBy("band").agg(pick.alias("best"), F.count("*").alias("parts")).where("parts > 1")
            hubs = hubs.select("band", "best.hub.hub", F.col("best.hub.total").alias("hub_total"), F.col("best.component").alias("within"))
            # A similarity is at most the lesser total weight over the greater; totals are sums of single-precision weights in another order.
            near = F.least("total", "hub_total") >= THRESHOLD * (1 - 1e-5) * F.greatest("total", "hub_total")
            pairs = now.join(hubs, "band").where(F.col("component") != F.col("within")).where(near).select("node", "hub").distinct()
            todo = stage(pairs)
            found = stage(_star_links(todo, texts, weights))
        else:
            todo = stage(now)
            found = stage(_full_links(todo, texts, weights))
        discard(todo)
        if found.isEmpty():
            continue
        # Links stand between components, so the components of these are what the new ones are.
        edges = found.join(classes.withColumnsRenamed({"node": "a", "component": "ca"}), "a").join(classes.withColumnsRenamed({"node": "b", "component": "cb"}), "b")
        joined = connected_components(edges.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("least"))
        classes = stage(classes.join(joined, "component", "left").select("node", F.coalesce("least", "component").alias("component")))
    least = nodes.select("node", "digest", "best").join(classes, "node")
    named = least.select("digest", "component").join(least.groupBy("component").agg(F.min("best").alias("least")), "component")
    named = nodes.select("digest", "best").join(named.select("digest", "least"), "digest", "left").select("digest", F.coalesce("least", "best").alias("least"))
    found = signed.select("id", "k1", "k2", "digest").join(named, "digest", "left")
    alone = F.col("least").isNull()
    kept = alone | ((F.col("k1") == F.col("least.k1")) & (F.col("k2") == F.col("least.k2")))
    return found.select("id", "k1", "k2", F.when(alone, F.col("id")).otherwise(F.col("least.id")).alias("class_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``class_id`` and ``kept`` of each row."""
    return _classes(docs, key, text).select(F.col("id").alias(key), "class_id", "kept")


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, all columns: the kept one; of rows alike in id and text, one."""
    found = stage(_classes(docs, key, text).select("k1", "k2", "kept"))
    gone = found.where(~F.col("kept")).select("k1", "k2").distinct()
    repeated = found.where("kept").groupBy("k1", "k2").count().where("count > 1").select("k1", "k2")
    k1, k2 = _row_hash(F.col(key), F.col(text))
    rows = docs.withColumn("_row_k1", k1).withColumn("_row_k2", k2)
    names = {"k1": "_row_k1", "k2": "_row_k2"}
    repeated = repeated.withColumnsRenamed(names)
    left_out = gone.withColumnsRenamed(names).unionByName(repeated)
    on = list(names.values())
    once = rows.join(repeated, on, "left_semi").dropDuplicates(on)
    return rows.join(left_out, on, "left_anti").select(docs.columns).unionByName(once.select(docs.columns))
