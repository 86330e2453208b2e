"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are read as lower-cased words. Every ``TILE`` words of an item are a seed, known by a rolling hash
(Karp-Rabin); documents are joined with items on the hashes they share. An item leaves out of the join its commonest seeds (of those in more
than ``COMMON`` texts) as long as the words that they cover together are fewer than it needs: where it is leaked, other seeds cover the rest.
A phrase that many items and documents share thus makes no pairs by itself. A pair stays while its shared seeds may cover what is needed, first by their
sums, then by the union of their places, and is then tiled: the longest match not yet marked is marked as a tile on both sides, what
it cuts off from other matches is matched again, and so on while ``TILE`` words are left. An item is leaked into a document
when its tiles cover ``COVERAGE`` of its words, in whatever order the passages stand. An item of fewer than ``TILE`` words is one seed of
its own length: it is leaked where its words stand together.

Documents are read once for their seeds. A Bloom filter of the items' hashes, of at most 2**``MOST_BITS`` bits however large the benchmark is,
passes over nearly all that hit nothing; the others go, each distinct text once, into the joins, which Spark sizes. In tiling, a document's text
stands before its items', one after the other, so no task holds more than one of either.

Special cases: null and empty texts hold nothing; texts of any length and repetition are read whole (memory grows with the text, not with its
matches); repeated rows are judged alike; of items equally covered the one with the least id is named; null item ids come last
and items without words are leaked nowhere; an empty benchmark leaves all documents clean, and empty documents give an empty result; other
columns aren't read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.batches import slices, texts_of
from skein.stage import stage

TILE, COVERAGE = 5, 0.5
#: Texts that hold a seed before items try to do without it. Any number gives the same results.
COMMON = 100
#: Bits of the filter for each seed, and the least and most of them in all, as powers of two; parts in which it is put together.
BITS_PER_SEED, LEAST_BITS, MOST_BITS, PARTS = 1024, 16, 27, 16
TABLE_WORDS = 500_000

_words = re.compile(r"\w+").findall
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Coder:
    """Hashes of a text's words; keeps a bounded table of them."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = _words(text.lower())
        if len(self.known) > TABLE_WORDS:
            self.known = {}
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def rolling(codes: np.ndarray, size: int = TILE) -> np.ndarray:
    """Hash of each ``size`` words: a polynomial in _BASE, modulo 2**64, that starts from the size."""
    n = len(codes) - size + 1
    out = np.full(max(n, 0), size, np.uint64)
    for j in range(size):
        out = out * _BASE + codes[j : j + n] if n > 0 else out
    return out


def _runs(doc: np.ndarray, item: np.ndarray, tile: int) -> list[tuple[int, int, int]]:
    """Maximal runs of shared seeds on one diagonal: (-length in words, document position, item position).

    Item positions are gone through from the last; only the runs at the one after are held.
    """
    seeds, wanted = rolling(doc, tile), rolling(item, tile)
    order = np.argsort(seeds, kind="stable")
    ranked = seeds[order]
    first, end = np.searchsorted(ranked, wanted), np.searchsorted(ranked, wanted, side="right")
    length = np.zeros(len(seeds) + 1, np.int64)  # of the run that begins at a document position and the item position after
    before, out = np.zeros(0, np.int64), []
    for i in range(len(wanted) - 1, -1, -1):
        at = order[first[i] : end[i]]
        longer = length[at + 1] + 1
        length[before] = 0
        length[at] = longer
        before = at
        begins = (at == 0) | (seeds[at - 1] != wanted[i - 1]) if i else np.ones(len(at), bool)
        out += zip((-(longer[begins] + tile - 1)).tolist(), at[begins].tolist(), [i] * int(begins.sum()), strict=True)
    return out


def tiles(doc: np.ndarray, item: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy tiling of ``item`` by ``doc``: (length, document position, item position); the longest first, then the first in document and item."""
    tile = min(TILE, len(item))
    if not tile:
        return []
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    heap, out, left = _runs(doc, item, tile), [], len(item)
    heapq.heapify(heap)
    while heap and left >= tile:
        n, d, i = heapq.heappop(heap)
        n = -n
        free = free_doc[d : d + n] & free_item[i : i + n] & (doc[d : d + n] == item[i : i + n])
        if free.all():
            free_doc[d : d + n] = False
            free_item[i : i + n] = False
            left -= n
            out.append((n, d, i))
            continue
        ends = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for a, b in zip(ends[::2].tolist(), ends[1::2].tolist(), strict=True):
            if b - a >= tile:
                heapq.heappush(heap, (a - b, d + a, i + a))
    return out


def needed(words: int, coverage: float) -> int:
    """Words of an item that its tiles must cover."""
    return max(1, math.ceil(coverage * words - 1e-9))


def leave_out(seeds: np.ndarray, size: int, need: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words covered by the seeds of ``common`` (the first ones first) that are left out, and which places of ``seeds`` stay.

    Seeds are left out while all the words that they cover are fewer than ``need``.
    """
    covered, stay, n = np.zeros(len(seeds) + max(size - 1, 0), bool), np.ones(len(seeds), bool), 0
    order = np.argsort(seeds, kind="stable")
    first, end = (np.searchsorted(seeds[order], common, side=side) for side in ("left", "right"))
    for a, b in zip(first.tolist(), end.tolist(), strict=True):
        at = order[a:b]
        places = np.unique(at[:, None] + np.arange(size))
        more = int(np.count_nonzero(~covered[places]))
        if n + more < need:
            covered[places] = True
            stay[at] = False
            n += more
    return covered, stay


def may_cover(known: np.ndarray, item: np.ndarray, coverage: float) -> bool:
    """Whether the seeds of ``item`` (of ``TILE`` words and more) among ``known`` (sorted) cover the words it needs. Tiles lie within what they cover."""
    wanted = rolling(item)
    if not len(known):
        return False
    hit = known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted
    return int(np.count_nonzero(np.convolve(hit, np.ones(TILE, np.int64)))) >= needed(len(item), coverage)


def _text_hash(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _seeds(items: DataFrame, coverage: float) -> DataFrame:
    """``hash, item, words, need, size`` of each distinct seed that an item (``item, text, common``) doesn't leave out.

    ``words`` is what the seed covers at most beside those left out, ``need`` what all of them must cover.
    """
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("hash", "item", "words", "need", "size")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Coder()
        for batch in slices(batches):
            for item, text, common in zip(batch.column("item").to_pylist(), texts_of(batch), batch.column("common").to_pylist(), strict=True):
                codes = code(text)
                size = min(TILE, len(codes))
                seeds = rolling(codes, size) if size else np.zeros(0, np.uint64)
                need = needed(len(codes), coverage)
                covered, stay = leave_out(seeds, size, need, np.array(common or [], np.int64).view(np.uint64))
                free = np.concatenate([[0], np.cumsum(~covered)])
                hashes, which = np.unique(seeds, return_inverse=True)
                words = np.bincount(which[stay], (free[size:] - free[: len(free) - size])[stay] if size else None, len(hashes))
                keep = words > 0
                n = int(keep.sum())
                columns = [hashes[keep].view(np.int64), np.full(n, item), words[keep], np.full(n, need - int(covered.sum())), np.full(n, size)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=schema.names)

    return items.select("item", "text", "common").mapInArrow(run, schema)


def _candidates(texts: DataFrame, seeds: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    """``t1, t2, item`` of texts (``t1, t2, hashes``) and items whose shared seeds may cover enough of the item."""
    found = texts.select("t1", "t2", F.explode("hashes").alias("hash"))
    common = stage(found.groupBy("hash").count().where(F.col("count") > COMMON))
    if not common.isEmpty():
        held = seeds.join(common, "hash").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("count", "hash")), asc=False).alias("common"))
        held = stage(held.select("item", F.col("common.hash").alias("common")))
        lighter = stage(_seeds(items.select("item", "text").join(held, "item"), coverage))
        seeds = seeds.join(held, "item", "left_anti").unionByName(lighter)
    shared = found.join(seeds, "hash").groupBy("t1", "t2", "item").agg(F.sum("words").alias("words"), F.first("need").alias("need"))
    return shared.where("words >= need").select("t1", "t2", "item")


def _probe(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the filter for each hash."""
    a = hashes * np.uint64(0xD6E8FEB86659FD93)
    b = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    shift = np.uint64(64 - bits)
    return (a >> shift).astype(np.int64), (b >> shift).astype(np.int64)


class Filter:
    """Bloom filter of the items' seeds, and the seeds' sizes in words."""

    def __init__(self, seeds: DataFrame):
        counted = seeds.groupBy("size").count().collect()  # at most TILE rows
        self.sizes = sorted(r["size"] for r in counted)
        n = sum(r["count"] for r in counted)
        self.bits = bits = min(MOST_BITS, max(LEAST_BITS, (n * BITS_PER_SEED).bit_length()))
        share = (1 << bits) // 8 // PARTS
        schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("held", T.BinaryType())])

        def emit(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
            pack = zstandard.ZstdCompressor(level=1).compress
            return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([pack(v.tobytes()) for v in parts.values()], pa.binary())], names=schema.names)

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((1 << bits) // 8, np.uint8)
            for batch in batches:
                for at in _probe(batch.column(0).to_numpy().view(np.uint64), bits):
                    np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
            if held.any():
                yield emit(dict(enumerate(held.reshape(PARTS, share))))

        def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, np.ndarray] = {}
            unpack = zstandard.ZstdDecompressor().decompress
            for batch in batches:
                for part, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    values = np.frombuffer(unpack(held), np.uint8)
                    parts[part] = parts[part] | values if part in parts else values
            if parts:
                yield emit(parts)

        self.held = np.zeros((PARTS, share), np.uint8)
        for part, held in seeds.select("hash").mapInArrow(mark, schema).repartition(PARTS, "part").mapInArrow(unite, schema).collect():  # PARTS rows
            self.held[part] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(held)), np.uint8)
        self.held = self.held.ravel()

    def hits(self, codes: np.ndarray) -> np.ndarray:
        """Distinct seeds of a text that may be an item's."""
        out = [np.zeros(0, np.uint64)]
        for size in self.sizes:
            found = rolling(codes, size)
            a, b = _probe(found, self.bits)
            out.append(found[((self.held[a >> 3] >> (a & 7)) & (self.held[b >> 3] >> (b & 7)) & 1).astype(bool)])
        return np.unique(np.concatenate(out))


def _with_hits(texts: DataFrame, held: Filter) -> DataFrame:
    """``t1, t2, text, hashes`` of the texts that hit the filter."""
    schema = T.StructType([*texts.schema.fields, T.StructField("hashes", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Coder()
        for batch in slices(batches):
            hits = [held.hits(code(t)) for t in texts_of(batch)]
            counts = np.array([len(h) for h in hits], np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *hits]).view(np.int64)
            hashes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, hashes], names=schema.names).filter(pa.array(counts > 0))

    return texts.mapInArrow(run, schema)


def _tiled(pairs: DataFrame, texts: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """``t1, t2, item, coverage, n_tiles`` of pairs of a text and an item whose shared seeds cover ``least`` of it."""
    heads = texts.join(pairs.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi").select("t1", "t2", F.lit(-1).cast("long").alias("item"), "text")
    rows = heads.unionByName(pairs.join(items.select("item", "text"), "item").select("t1", "t2", "item", "text"))
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("coverage", T.DoubleType()), T.StructField("n_tiles", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, doc, known = Coder(), None, None
        for batch in slices(batches):
            keep, coverage, n_tiles = [], [], []
            for k, (item, text) in enumerate(zip(batch.column("item").to_pylist(), texts_of(batch), strict=True)):
                if item < 0:
                    doc = code(text)
                    known = np.unique(rolling(doc))
                    continue
                words = code(text)
                if len(words) >= TILE and not may_cover(known, words, least):
                    continue
                found = tiles(doc, words)
                keep.append(k)
                coverage.append(sum(t[0] for t in found) / len(words))
                n_tiles.append(len(found))
            keys = [batch.column(c).take(pa.array(keep, pa.int64())) for c in ("t1", "t2", "item")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(coverage, pa.float64()), pa.array(n_tiles, pa.int64())], names=schema.names)

    return rows.repartition("t1", "t2").sortWithinPartitions("t1", "t2", "item").mapInArrow(run, schema)


def _leaks(docs: DataFrame, benchmark: DataFrame, coverage: float, key: str, text: str) -> DataFrame:
    """``t1, t2, item_id, coverage, n_tiles`` of each distinct text that holds a leaked item: the best covered one."""
    if not 0 < coverage <= 1:
        raise ValueError("coverage is a share above 0")
    items = benchmark.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    items = stage(items.withColumn("item", F.monotonically_increasing_id()))  # written, so the numbers stay
    seeds = stage(_seeds(items.withColumn("common", F.lit(None).cast("array<long>")), coverage))
    read = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(*_text_hash("text"), "text")
    texts = stage(_with_hits(read, Filter(seeds)).dropDuplicates(["t1", "t2"]))
    pairs = stage(_candidates(texts, seeds, items, coverage))
    tiled = _tiled(pairs, texts, items, coverage).where(F.col("coverage") >= coverage - 1e-12).join(items.select("item", "id"), "item")
    best = F.min(F.struct((-F.col("coverage")).alias("less"), F.col("id").isNull().alias("none"), "id", "n_tiles")).alias("best")
    return tiled.groupBy("t1", "t2").agg(best).select("t1", "t2", F.col("best.id").alias("item_id"), (-F.col("best.less")).alias("coverage"), F.col("best.n_tiles").alias("n_tiles"))


def judge_documents(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``key``, ``item_id`` (of the best covered leaked item), its ``coverage`` and ``n_tiles``, and ``contaminated`` of each row; null, 0, 0 and false without a leak."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    leaks = stage(_leaks(rows, benchmark, coverage, item_key, item_text)).withColumn("contaminated", F.lit(True))
    judged = rows.select("id", *_text_hash("text")).join(leaks, ["t1", "t2"], "left")
    none = [F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("n_tiles", F.lit(0)).cast("long").alias("n_tiles")]
    return judged.select(F.col("id").alias(key), "item_id", *none, F.coalesce("contaminated", F.lit(False)).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text: str = "text") -> DataFrame:
    """The rows that hold no leaked item, with all their columns."""
    rows = docs.select(F.coalesce(text, F.lit("")).alias("text"))
    names = {"t1": "_text_t1", "t2": "_text_t2"}
    leaks = stage(_leaks(rows, benchmark, coverage, "item_id", "text").select("t1", "t2")).withColumnsRenamed(names)
    held = F.coalesce(text, F.lit(""))
    hashes = {names["t1"]: F.xxhash64(held), names["t2"]: F.xxhash64(F.lit(1), held)}
    return docs.withColumns(hashes).join(leaks, list(hashes), "left_anti").select(docs.columns)
