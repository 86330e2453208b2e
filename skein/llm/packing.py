"""Best-fit packing of documents into sequences of bounded length by a grouping genetic algorithm.

Documents are encoded once, whole, with an end id; longer ones are cut into full pieces, of which only the first may be shorter. Full pieces are sequences by themselves. The
others are dealt by hash into problems of some ``PROBLEM`` pieces, so no task grows with the corpus. Each problem is evolved on several islands: a solution is a list of
bins; crossover injects whole well-filled bins of one parent into another, removes the bins of the other that hold any of their pieces, and puts
displaced pieces, longest first, where they leave least room; mutation breaks up the emptiest bins and some others. A round evolves all islands as one Spark job whose result
is written, then each island's best solution migrates to the next island. Islands stop at the lower bound (of sums, and of pieces too long to share a bin). Every random number comes from problem, island and round,
so a task that runs again gives the same bins.

Sums of problems are rounded up one by one, so afterwards the emptiest bins of all problems are broken up and dealt into fewer problems, level by level, until one is left; a level counts if it saves bins.

Ids are those of a byte-level tokenizer, made from its vocabulary as ranks, which gives the same ids in a third of the time (tests hold one against the other). The special string has its id wherever it stands.

Special cases: null and empty texts are one end id; whitespace runs and unbroken texts of any length are encoded whole; pieces of a document need not follow each other; a repeated row is packed again, as a piece of its own; lengths that are null or not
positive take no room, and those over the capacity have a sequence of their own; pieces in a sequence are in the order of their rows; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.llm.batches import slices, texts_of
from skein.llm.lengths import _encoding, _long_run
from skein.stage import stage

CAPACITY, END_ID = 2048, 0
#: Pieces of a problem, on average (a hash deals them, so a tenth more is beyond chance); islands; rounds between migrations, and solutions made in each; solutions of an island.
PROBLEM, ISLANDS, ROUNDS, CHILDREN, POPULATION = 4096, 3, 4, 40, 8
#: Of a problem's bins, the part that the next level breaks up: one in this many, the emptiest.
REPACKED = 8
#: Characters encoded at once, and strings that stand for one id.
PIECE, SPECIAL = 1 << 20, {"<|endoftext|>": 50256}

_cut = re.compile(r"\S\s")


class Encoder:
    """Ids of texts as little-endian 32-bit numbers.

    No token spans the place where whitespace begins, so long texts are encoded in parts cut there; a long run of whitespace is one piece, less its last character if something follows.
    """

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int] = SPECIAL):
        self.encoding = _encoding(ranks_path, pattern)
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in special.items()}
        self.sections = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else lambda text: [text]

    def encode(self, text: str) -> bytes:
        return b"".join(self.special[section] if k % 2 else part for k, section in enumerate(self.sections(text)) for part in ([b""] if k % 2 else self.parts(section)))

    def parts(self, text: str) -> Iterator[bytes]:
        at = 0
        for run in _long_run(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            yield from self.plain(text[at : run.start()])
            yield np.array(self.encoding._encode_single_piece(text[run.start() : end]), "<u4").tobytes()
            at = end
        yield from self.plain(text[at:])

    def plain(self, text: str) -> Iterator[bytes]:
        at = 0
        while at < len(text):
            cut = _cut.search(text, at + PIECE)
            end = cut.start() + 1 if cut else len(text)
            yield self.encoding.encode_to_numpy(text[at:end], disallowed_special=()).astype("<u4").tobytes()
            at = end


def encode_pieces(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, piece, start, length, ids_crc32`` of each piece, and its ``ids`` if wanted."""
    fields = [docs.schema[key], T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(ranks_path, pattern).encode
        for batch in slices(batches):
            rows, ids = [], []
            for k, t in enumerate(texts_of(batch, text)):
                data = encode(t) + last
                n = len(data) // 4
                starts = [0, *range((n - 1) % capacity + 1, n, capacity)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    own = data[4 * a : 4 * b]
                    rows.append((k, piece, a, b - a, zlib.crc32(own)))
                    if with_ids:
                        ids.append(np.frombuffer(own, "<i4"))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)]
            wide = [pa.array(ids, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays([batch.column(key).take(columns[0]), *columns[1:], *wide], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing has at least: the better of the sum's, and those of pieces over half a bin with the room left beside them, for each least length counted."""
    count = np.bincount(lengths, minlength=capacity + 1)
    upto, weight = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    half = capacity // 2
    k = np.arange(0, half + 1)  # pieces over capacity - k can't be joined with any of k or more
    large, middle = upto[-1] - upto[half], np.minimum(upto[capacity - k], upto[-1]) - upto[half]
    room = middle * capacity - (weight[capacity - k] - weight[half])
    small = weight[half] - np.where(k > 0, weight[np.maximum(k, 1) - 1], 0)
    return int(np.max(large + np.maximum(0, -(-(small - room) // capacity))))


def place(order: list[int], lengths: list[int], bins: np.ndarray, free: np.ndarray, capacity: int) -> np.ndarray:
    """Puts pieces in turn into the bin where they leave least room, or a new one; returns the room left."""
    room: dict[int, list[int]] = {}
    for b in np.flatnonzero(free > 0).tolist():
        room.setdefault(int(free[b]), []).append(b)
    spaces = sum(1 << f for f in room)
    left = free.tolist()
    for i in order:
        size = lengths[i]
        fits = spaces >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = room[space].pop()
            if not room[space]:
                spaces &= ~(1 << space)
        else:
            b, space = len(left), capacity
            left.append(capacity)
        bins[i] = b
        space -= size
        left[b] = space
        if space:
            room.setdefault(space, []).append(b)
            spaces |= 1 << space
    return np.array(left)


class Island:
    """Solutions of one problem. A solution is a bin for each piece; pieces go from long to short."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: list[int]):
        self.lengths, self.capacity, self.rng = lengths.astype(np.int64), capacity, np.random.default_rng(seed)
        self.plain, self.bound = self.lengths.tolist(), lower_bound(self.lengths, capacity)

    def fitness(self, bins: np.ndarray) -> tuple[int, float]:
        """Fewer bins, then fuller ones beside emptier ones."""
        fills = np.bincount(bins, weights=self.lengths)
        return -len(fills), float((fills**2).sum())

    def fill(self, bins: np.ndarray, free: np.ndarray, displaced: np.ndarray, noise: float = 0.0) -> np.ndarray:
        """``displaced`` pieces best-fitted, longest first (or nearly); bins numbered anew."""
        order = displaced if not noise else displaced[np.argsort(-self.lengths[displaced] * self.rng.uniform(1 - noise, 1, len(displaced)), kind="stable")]
        place(order.tolist(), self.plain, bins, free, self.capacity)
        return np.unique(bins, return_inverse=True)[1]

    def start(self) -> list[np.ndarray]:
        """Best fit of the pieces from long to short, and of nearly that order."""
        every, none = np.arange(len(self.lengths)), np.zeros(0, np.int64)
        return [self.fill(np.zeros(len(every), np.int64), none, every, noise) for noise in np.linspace(0, 0.5, POPULATION)]

    def cross(self, into: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Well-filled bins of ``of`` injected whole into ``into``."""
        fills = np.bincount(of, weights=self.lengths)
        best = np.argsort(-fills, kind="stable")[: max(1, len(fills) // 2)]
        chosen = np.zeros(len(fills), bool)
        chosen[self.rng.choice(best, max(1, int(len(best) * self.rng.uniform(0.05, 0.3))), replace=False)] = True
        injected = chosen[of]
        hit = np.zeros(into.max() + 1, bool)
        hit[into[injected]] = True
        bins = np.where(injected, of + len(hit), into)
        free = self.capacity - np.bincount(bins, weights=self.lengths).astype(np.int64)
        free[: len(hit)][hit] = free[len(hit) :][~chosen[: len(free) - len(hit)]] = 0  # bins that are gone take nothing
        return self.fill(bins, free, np.flatnonzero(hit[into] & ~injected))

    def mutate(self, bins: np.ndarray) -> np.ndarray:
        """The emptiest bins and some others broken up."""
        free = self.capacity - np.bincount(bins, weights=self.lengths).astype(np.int64)
        n = int(self.rng.integers(2, 12))
        gone = np.zeros(len(free), bool)
        gone[np.argsort(-free, kind="stable")[:n]] = gone[self.rng.integers(0, len(free), n)] = True
        return self.fill(bins.copy(), np.where(gone, 0, free), np.flatnonzero(gone[bins]), float(self.rng.choice([0.0, 0.2])))

    def evolve(self, population: list[np.ndarray], migrant: np.ndarray | None, children: int) -> list[np.ndarray]:
        """The population from best to worst after ``children`` new solutions, or at the lower bound."""
        some = [*population, *([migrant] if migrant is not None else [])] or self.start()
        ranked = sorted(((self.fitness(s), k, s) for k, s in enumerate(some)), key=lambda x: (x[0], -x[1]), reverse=True)[:POPULATION]
        for k in range(children):
            if -ranked[0][0][0] <= self.bound:
                break
            a, b = np.sort(self.rng.integers(0, len(ranked), (2, 2)), axis=1)[:, 0].tolist()  # the better of two each
            child = self.mutate(ranked[a][2]) if a == b or self.rng.random() < 0.5 else self.cross(ranked[a][2], ranked[b][2])
            fit = self.fitness(child)
            if fit > ranked[-1][0] and all(fit != r[0] for r in ranked):
                ranked = sorted([*ranked, (fit, len(some) + k, child)], key=lambda x: (x[0], -x[1]), reverse=True)[:POPULATION]
        return [s for _, _, s in ranked]


def _evolved(state: DataFrame, capacity: int, turn: int) -> DataFrame:
    schema = T.StructType([T.StructField("problem", T.LongType()), T.StructField("island", T.IntegerType()), T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("population", T.ArrayType(T.ArrayType(T.ShortType()))), T.StructField("best", T.ArrayType(T.ShortType())), T.StructField("n_bins", T.IntegerType()), T.StructField("spread", T.DoubleType()), T.StructField("bound", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            problem, island = batch.column("problem")[0].as_py(), batch.column("island")[0].as_py()
            here = Island(batch.column("lengths").flatten().to_numpy(), capacity, [problem & 0xFFFFFFFF, problem >> 32, island, turn])
            population = [np.array(s, np.int64) for s in batch.column("population")[0].as_py() or []]
            migrant = batch.column("migrant")[0].as_py()
            ranked = here.evolve(population, None if migrant is None else np.array(migrant, np.int64), CHILDREN)
            n, spread = here.fitness(ranked[0])
            made = [[s.astype(np.int16) for s in ranked]], [ranked[0].astype(np.int16)], [-n], [spread], [here.bound]
            columns = [pa.array(v, t) for v, t in zip(made, (pa.list_(pa.list_(pa.int16())), pa.list_(pa.int16()), pa.int32(), pa.float64(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("problem", "island", "lengths")), *columns], names=schema.names)

    return state.select("problem", "island", "lengths", "population", "migrant").mapInArrow(run, schema)


def _solve(items: DataFrame, capacity: int) -> DataFrame:
    """``node, length, problem, bin`` of pieces (``node, length, problem``)."""
    items = stage(items.withColumn("place", F.row_number().over(Window.partitionBy("problem").orderBy(F.desc("length"), "node")) - 1))
    problems = items.groupBy("problem").agg(F.sort_array(F.collect_list(F.col("length").cast("int")), asc=False).alias("lengths"))  # bounded by the dealing
    state = problems.select("problem", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths", F.lit(None).cast("array<array<short>>").alias("population"), F.lit(None).cast("array<short>").alias("migrant"))
    state = stage(_evolved(state.repartition("problem", "island"), capacity, 0))
    for turn in range(1, ROUNDS):
        if state.groupBy("problem").agg((F.min("n_bins") > F.first("bound")).alias("open")).where("open").isEmpty():
            break
        elite = state.select("problem", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("best").alias("migrant"))
        state = stage(_evolved(state.join(elite, ["problem", "island"]).repartition("problem", "island"), capacity, turn))
    best = state.groupBy("problem").agg(F.max_by("best", F.struct(-F.col("n_bins"), "spread", -F.col("island"))).alias("best"))
    return items.join(best.select("problem", F.posexplode("best").alias("place", "bin")), ["problem", "place"]).select("node", "length", "problem", F.col("bin").cast("int").alias("bin"))


def pack(rows: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """``rows`` with ``sequence_id`` (any number) and ``offset`` (room taken before it in the sequence)."""
    names = {c.lower() for c in rows.columns}
    node = next(n for n in ("node", *(f"node_{k}" for k in range(len(names) + 1))) if n not in names)
    own = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    size = F.coalesce(F.greatest(F.col(length), F.lit(0)), F.lit(0)).cast("long")
    rows = stage(rows.select(*own, F.monotonically_increasing_id().alias(node)))  # written, so the numbers stay
    items = rows.select(F.col(node).alias("node"), size.alias("length"))
    pool, small = items.where(F.col("length") < capacity), 0
    left, level, settled = pool.count(), 0, None
    problems = max(1, -(-left // PROBLEM))
    while left:
        dealt = pool.select("node", "length", F.pmod(F.xxhash64("node", F.lit(level)), F.lit(problems)).alias("problem"))
        packed = stage(_solve(dealt, capacity).withColumn("level", F.lit(level)))
        if settled is not None:
            bins = packed.select("problem", "bin").distinct().count()
            if bins >= small:
                break
            settled = settled.join(pool.select("node"), "node", "left_anti").unionByName(packed)
        else:
            settled = packed
        settled = stage(settled)
        if problems == 1:
            break
        fills = packed.groupBy("problem", "bin").agg(F.sum("length").alias("fill"))
        numbered = fills.withColumn("k", F.row_number().over(Window.partitionBy("problem").orderBy("fill", "bin"))).withColumn("n", F.count("*").over(Window.partitionBy("problem")))
        emptiest = numbered.where(F.col("k") <= F.ceil(F.col("n") / REPACKED)).select("problem", "bin")
        pool = stage(packed.join(emptiest, ["problem", "bin"]).select("node", "length", "problem", "bin"))
        small, left = pool.select("problem", "bin").distinct().count(), pool.count()
        pool, fewer, level = pool.select("node", "length"), max(1, -(-left // PROBLEM)), level + 1
        if fewer >= problems:
            break
        problems = fewer
    whole = items.where(F.col("length") >= capacity).select("node", (-1 - F.col("node")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if settled is not None:
        sequence = F.shiftleft(F.shiftleft(F.col("level").cast("long"), 36) + F.col("problem"), 14) + F.col("bin")
        before = Window.partitionBy("sequence_id").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = settled.select("node", "length", sequence.alias("sequence_id"))
        whole = whole.unionByName(placed.select("node", "sequence_id", (F.sum("length").over(before) - F.col("length")).alias("offset")))
    return rows.join(whole.withColumnRenamed("node", node), node).drop(node)


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(encode_pieces(docs, ranks_path, pattern, capacity, with_ids=with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and its ``ids``, from pieces that were packed with their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))  # bounded by the capacity, as each piece has an id at least
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
