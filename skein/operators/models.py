"""Batch rating models. Each returns tables; scoring joins them to the requested pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators import cells, nearest
from skein.operators.graph import ranked
from skein.stage import discard, stage, stage_parted


def limits(ratings: DataFrame) -> tuple[float, float, float]:
    """Mean, least and greatest rating."""
    return ratings.agg(F.avg("rating"), F.min("rating"), F.max("rating")).first()


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


#: Rounds of biases that are made by joins of rows; more are made over packed cells, which take some passes to lay out.
PLAIN_ROUNDS = 4


def bias_tables(
    ratings: DataFrame, shrink: float = 10.0, rounds: int = 1, item_shrink: float | None = None, weights: tuple[float, float] = (1.0, 1.0), mean: float | None = None
) -> tuple[DataFrame, DataFrame, tuple[float, float, float]]:
    """``u, bu`` and ``i, bi`` of alternating shrunken biases, and (mean, low, high). ``weights`` multiply users' and items'; ``mean`` replaces the rows' own."""
    average, low, high = limits(ratings)
    mean = average if mean is None else mean
    (wu, wi), item_shrink = weights, shrink if item_shrink is None else item_shrink
    rounds = max(1, rounds)
    if rounds > PLAIN_ROUNDS:
        return *_bias_rounds(ratings, mean, (shrink, item_shrink), rounds, weights), (mean, low, high)
    rows = ratings.select("u", "i", (F.col("rating") - mean).alias("e"))
    bi, bu = None, None
    for round_ in range(rounds):
        left = rows if bi is None else rows.join(bi, "i").withColumn("e", F.col("e") - F.col("bi"))
        bu = left.groupBy("u").agg((wu * F.sum("e") / (shrink + F.count("*"))).alias("bu"))
        # One table a round: users' biases are made on the way to the items'; the last round's are written, as they are returned.
        bu = stage(bu) if round_ == rounds - 1 else bu
        bi = stage(rows.join(bu, "u").groupBy("i").agg((wi * F.sum(F.col("e") - F.col("bu")) / (item_shrink + F.count("*"))).alias("bi")))
    return bu, bi, (mean, low, high)


def _bias_rounds(ratings: DataFrame, mean: float, shrinks: tuple[float, float], rounds: int, weights: tuple[float, float]) -> tuple[DataFrame, DataFrame]:
    """``u, bu`` and ``i, bi`` by rounds over packed cells: a side's bias is weight (sum of e - sum of the other side's biases) / (shrink + count), so that a round moves biases and their sums only.

    Ratings are numbered and laid out twice, by users' and by items' blocks. Ratings without a user or an item count for the mean alone, as in a join; rows without a rating count as rows.
    """
    rows = stage(ratings.where("u is not null and i is not null").select("u", "i", (F.col("rating") - mean).alias("e")))
    own = {k: stage(rows.groupBy(k).agg(F.coalesce(F.sum("e"), F.lit(0.0)).alias("s"), F.count("*").alias("n"))) for k in "ui"}
    numbers, size = {}, {}
    for k in "ui":
        numbers[k], size[k] = cells.numbered(own[k].select(k), k)
    places = rows.where("e is not null")
    for k, (block, at) in (("u", ("p", "x")), ("i", ("q", "y"))):
        places = places.join(numbers[k].select(k, F.col("block").alias(block), F.col("at").alias(at)), k)
    places = stage(places.select("p", "x", "q", "y"))
    from_users = cells.cells(places, size["i"])
    from_items = cells.cells(places.select(F.col("q").alias("p"), F.col("y").alias("x"), F.col("p").alias("q"), F.col("x").alias("y")), size["u"])
    discard(places, rows)
    known = {}
    for k, shrink, weight in zip("ui", shrinks, weights, strict=True):
        # A block's sums and counts as one row, by the same packing as the sums that come back.
        table = numbers[k].join(own[k], k).select("block", "at", "s", "n")
        known[k] = stage(table.groupBy("block").applyInPandas(_packed_block(size[k], weight, shrink), "block int, s binary, n binary"))
    values = {"i": None}
    for _ in range(rounds):
        for k, there, other in (("u", from_items, "i"), ("i", from_users, "u")):
            before = values.get(k)
            start = known[k].select("block", "s", "n", F.lit(None).cast("binary").alias("places"), F.lit(None).cast("binary").alias("sums"))
            if values[other] is not None:
                start = start.unionByName(there.sums(values[other]), allowMissingColumns=True)
            values[k] = stage(start.groupBy("block").applyInArrow(_biases(size[k]), "block int, v binary"))
            if before is not None:
                discard(before)
    out = []
    for k in "ui":
        out.append(stage(numbers[k].join(cells.unpacked(values[k]), ["block", "at"]).select(k, F.col("v").alias(f"b{k}"))))
    discard(from_users.pieces, from_items.pieces, *values.values(), *known.values(), *numbers.values(), *own.values())
    return tuple(out)


def _packed_block(size: int, weight: float, shrink: float):
    def pack(data: pd.DataFrame) -> pd.DataFrame:
        s, n = np.zeros(size), np.full(size, np.inf)
        s[data["at"]], n[data["at"]] = data["s"], (shrink + data["n"]) / weight if weight else np.inf
        return pd.DataFrame({"block": data["block"].iloc[:1].astype("int32"), "s": [s.tobytes()], "n": [n.tobytes()]})

    return pack


def _biases(size: int):
    """A block's biases from its row of sums and shrunken counts, and the sums of the other side's."""

    def make(table: pa.Table) -> pa.Table:
        known = table.filter(table.column("s").is_valid())
        came = table.filter(table.column("sums").is_valid())
        parts = sorted(zip(came.column("places").to_pylist(), came.column("sums").to_pylist(), strict=True))  # always in one order
        s, n = (np.frombuffer(known.column(c)[0].as_py(), np.float64) for c in "sn")
        v = (s - cells.gathered([x for _, x in parts], [x for x, _ in parts], size)) / n
        return pa.table({"block": pa.array([known.column("block")[0].as_py()], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})

    return make


def score_bias(requests: DataFrame, bu: DataFrame, bi: DataFrame, ends: tuple[float, float, float]) -> DataFrame:
    """``requests`` with ``score``; unknown users and items have bias 0."""
    mean, low, high = ends
    raw = F.lit(mean) + F.coalesce("bu", F.lit(0.0)) + F.coalesce("bi", F.lit(0.0))
    return requests.join(bu, "u", "left").join(bi, "i", "left").withColumn("score", clip(raw, low, high)).drop("bu", "bi")


def blend(base: DataFrame, other: DataFrame, weight: float, ends: tuple[float, float, float]) -> DataFrame:
    """``u, i, score``: (1 - weight) base + weight other, both clipped, and the sum again."""
    if not 0 <= weight <= 1:
        raise ValueError("weight lies outside 0..1")
    _, low, high = ends
    both = base.select("u", "i", F.col("score").alias("a")).join(other.select("u", "i", F.col("score").alias("b")), ["u", "i"])
    return both.select("u", "i", clip((1 - weight) * clip(F.col("a"), low, high) + weight * clip(F.col("b"), low, high), low, high).alias("score"))


def ensemble(scored: list[tuple[float, DataFrame]], ends: tuple[float, float, float], intercept: float = 0.0, normalize: bool = False) -> DataFrame:
    """``u, i, score``: weighted sum of clipped scores, aggregated in long form: one shuffle for any number of models."""
    total = sum(w for w, _ in scored)
    if (normalize and total <= 0) or not any(w for w, _ in scored):
        raise ValueError("weights must have a positive sum to be normalised, and one must not be 0")
    _, low, high = ends
    long = None
    for w, df in scored:
        part = df.select("u", "i", (clip(F.col("score"), low, high) * (w / total if normalize else w)).alias("part"))
        long = part if long is None else long.unionByName(part)
    return long.groupBy("u", "i").agg(clip(F.sum("part") + intercept, low, high).alias("score"))


#: Ratings or requests in a block of users of :func:`neighbours`, about; ratings that pass by one of its tasks, about; products of two ratings held at once.
KNN_ROWS, KNN_PASSING, PRODUCTS = 6_000_000, 45_000_000, 2_000_000


def neighbours(requests: DataFrame, residuals: DataFrame, k: int, absolute: bool = True) -> DataFrame:
    """``u, i, v, s, e``: for each distinct request the k raters of its item most like its user (ties: least id), with their likeness and residual.

    Likeness is the shrunken cosine of residuals over shared items; raters without one aren't taken. Users are dealt into blocks of some ``KNN_ROWS`` ratings by ranges of ids. A task holds a block's users that request
    something (:mod:`skein.operators.nearest`); all ratings of items that the block has to do with pass by it, packed. So no pair of users is ever a row: a rating is sent once to each block that has to do with its item, and
    at most k rows for each request, task and run of users come back. Where more than ``KNN_PASSING`` ratings would pass by, they are dealt over several tasks that all hold the block.
    A user's ratings, one for each item at most, are in one piece. ``residuals`` are read several times.
    """
    asked = stage(requests.select("u", "i").where("u is not null and i is not null").distinct())
    rated = residuals.select("u", "i", "e").where("u is not null and i is not null and e is not null")
    rows = rated.unionByName(asked.select("u", "i", F.lit(None).cast("double").alias("e")))
    counts = rows.agg(F.count("e").alias("r"), F.count("*").alias("n")).first()
    blocks = max(1, math.ceil(max(counts["r"], counts["n"] - counts["r"]) / KNN_ROWS))
    parts = max(1, math.ceil(counts["r"] / KNN_PASSING))
    cuts = F.percentile_approx("u", F.array(*[F.lit(b / blocks) for b in range(1, blocks)]), 10_000)
    bounds = (rows.agg(cuts).first()[0] or []) if blocks > 1 else []  # a number a block
    block = F.size(F.filter(F.array(*[F.lit(int(b)).cast("long") for b in bounds]), lambda b: b < F.col("u"))) if bounds else F.lit(0)
    # The blocks that have to do with an item, as bits of words.
    bit = lambda w: F.expr(f"bit_or(if(_b div {nearest.BITS} = {w}, shiftleft(1L, _b % {nearest.BITS}), 0L))").alias(f"m{w}")
    meets = rows.select("i", block.alias("_b")).groupBy("i").agg(*[bit(w) for w in range(-(-blocks // nearest.BITS))])
    laid = rows.join(meets, "i").select("u", "i", "e", *meets.columns[1:]).repartition("u").sortWithinPartitions("u", "i")
    sent = laid.mapInArrow(nearest.sender(bounds, parts), nearest.SENT)
    find = nearest.finder(k, absolute, PRODUCTS)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from find(batches)

    near = sent.repartition("p", "q").sortWithinPartitions("p", "q", "kind").groupBy("p", "q").applyInArrow(best, "u long, i long, v long, s double, e double")
    order = F.abs("s") if absolute else F.col("s")
    return near.withColumn("n", F.row_number().over(Window.partitionBy("u", "i").orderBy(order.desc(), "v"))).where(F.col("n") <= k).drop("n")


def user_knn(requests: DataFrame, ratings: DataFrame, k: int = 40, shrink: float = 1.0, bias: tuple | None = None, absolute: bool = True) -> DataFrame:
    """``u, i, score``: the bias score plus the similarity-weighted residuals of the k raters most alike (ties: least id). Repeated requests are scored alike."""
    if k < 1:
        raise ValueError("k is below 1")
    bu, bi, ends = bias or bias_tables(ratings)
    base = score_bias(requests.select("u", "i"), bu, bi, ends)
    once = ratings.groupBy("u", "i").agg(F.max("rating").alias("rating"))
    residuals = stage(score_bias(once, bu, bi, ends).select("u", "i", (F.col("rating") - F.col("score")).alias("e")))
    best = neighbours(requests, residuals, k, absolute)
    change = best.groupBy("u", "i").agg((F.sum(F.col("s") * F.col("e")) / (F.sum(F.abs("s")) + shrink)).alias("change"))
    _, low, high = ends
    return base.join(change, ["u", "i"], "left").select("u", "i", clip(F.col("score") + F.coalesce("change", F.lit(0.0)), low, high).alias("score"))


def als_scores(requests: DataFrame, ratings: DataFrame, rank: int = 8, rounds: int = 5, reg: float = 0.1, weight: float = 1.0, seed: int = 1, bias: tuple | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``u, i, score``, and those columns of the requests that ``keep`` names: alternating least squares on the bias model's residuals; pairs that it doesn't know keep the bias score.

    This is the model that scales. Its solver takes ids of 32 bits, so ids are numbered first. A side's biases, numbers and factors are one table, so that ratings and requests move once for each side;
    the solver's rows are written before it reads them, which it does twice. Ratings that lie by user (:func:`skein.stage.stage_bucketed`) move for their items only.
    """
    from pyspark.ml.recommendation import ALS

    bu, bi, ends = bias or bias_tables(ratings)
    mean, low, high = ends
    sides = {}
    for k, known in (("u", bu), ("i", bi)):
        ids = ranked(ratings.select(k).where(F.col(k).isNotNull()).distinct(), k, f"_{k}").select(k, F.col(f"_{k}").cast("int").alias(f"_{k}"))
        sides[k] = stage(ids.join(known.select(k, f"b{k}"), k, "full"))
    base = clip(F.lit(mean) + F.coalesce("bu", F.lit(0.0)) + F.coalesce("bi", F.lit(0.0)), low, high)
    fitted = ratings.join(sides["u"], "u").join(sides["i"], "i")
    fitted = stage(fitted.select("_u", "_i", (F.col("rating") - base).cast("float").alias("e")))
    model = ALS(rank=rank, maxIter=rounds, regParam=reg, userCol="_u", itemCol="_i", ratingCol="e", coldStartStrategy="nan", seed=seed).fit(fitted)
    scored = requests.select("u", "i", *keep)
    for k, factors in (("u", model.userFactors), ("i", model.itemFactors)):
        scored = scored.join(sides[k].join(factors.select(F.col("id").alias(f"_{k}"), F.col("features").alias(f"_f{k}")), f"_{k}", "left").drop(f"_{k}"), k, "left")
    dot = F.aggregate(F.zip_with("_fu", "_fi", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    return scored.select("u", "i", *keep, clip(base + weight * F.coalesce(F.nanvl(dot, F.lit(0.0)), F.lit(0.0)), low, high).alias("score"))


#: Ratings in a pair of blocks of :func:`sgd_factors`, about, and ids in a pair; ratings of a piece, and ids of one.
BLOCK_RATINGS, BLOCK_IDS, SGD_PIECE, ID_PIECE = 2_000_000, 2_000_000, 20_000, 50_000
#: Levels that are found at once; what is left after them is walked rating by rating.
LEVELS = 64


def _before(ids: np.ndarray) -> np.ndarray:
    """For each place the one before it with the same id, or -1."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), -1)
    same = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
    out[order[same + 1]] = order[same]
    return out


def _levels(u: np.ndarray, i: np.ndarray) -> np.ndarray:
    """A level for each rating in turn: one above those of the ratings before it of the same user or item. Ratings of one level share no factor."""
    by_user, by_item = _before(u), _before(i)
    level = np.full(len(u) + 1, -1)  # the last place stands for none before
    done = np.zeros(len(u) + 1, bool)
    done[-1] = True
    left = np.arange(len(u))
    for k in range(LEVELS):
        if not len(left):
            break
        ready = done[by_user[left]] & done[by_item[left]]
        level[left[ready]] = k
        done[left[ready]] = True
        left = left[~ready]
    if len(left):
        found = level.tolist()
        for at, a, b in zip(left.tolist(), by_user[left].tolist(), by_item[left].tolist(), strict=True):
            found[at] = max(found[a], found[b]) + 1
        level = np.array(found)
    return level[:-1]


def _descend(users: tuple, items: tuple, u: np.ndarray, i: np.ndarray, e: np.ndarray, rate: float, reg: float) -> None:
    """Steps of one sequential descent over ratings in their order, in place; ``users`` and ``items`` are (biases, factors) and ``u`` and ``i`` places there. Steps of one level are made at once."""
    (bu, p), (bi, q) = users, items
    level = _levels(u, i)
    order = np.argsort(level, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(level[order])) + 1):
        a, b = u[at], i[at]
        x, y, s, t = p[a], q[b], bu[a], bi[b]
        off = e[at] - s - t - (x * y).sum(1)
        bu[a], bi[b] = s + rate * (off - reg * s), t + rate * (off - reg * t)
        p[a], q[b] = x + rate * (off[:, None] * y - reg * x), y + rate * (off[:, None] * x - reg * y)


def _pieces(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int) -> Iterator[tuple]:
    """Rows that come by ``keys`` (whole numbers) in pieces of at most so many: the keys' values and the other columns."""
    cell, held, n = None, [], 0
    for batch in batches:
        at = [batch.column(c).to_numpy() for c in keys]
        rest = [batch.column(c).to_numpy() for c in batch.schema.names if c not in keys]
        first = 0
        while first < batch.num_rows:
            now = tuple(int(c[first]) for c in at)
            if held and (now != cell or n >= limit):
                yield cell, [np.concatenate(c) for c in zip(*held, strict=True)]
                held, n = [], 0
            cell = now
            ends = [np.flatnonzero(c[first:] != x) for c, x in zip(at, now, strict=True)]
            end = min([first + limit - n, batch.num_rows, *[first + int(e[0]) for e in ends if len(e)]])
            held.append([c[first:end] for c in rest])
            n += end - first
            first = end
    if held:
        yield cell, [np.concatenate(c) for c in zip(*held, strict=True)]


def _rows(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), schema, strict=True)], [n for n, _ in schema])


_FACTORS = [("kind", pa.int32()), ("block", pa.int32()), ("key", pa.int64()), ("a", pa.binary()), ("e", pa.binary()), ("factors", pa.binary())]
_RATINGS = [("stratum", pa.int32()), ("p", pa.int32()), ("key", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("e", pa.binary())]


def sgd_factors(ratings: DataFrame, rank: int = 8, epochs: int = 10, rate: float = 0.02, reg: float = 0.02, blocks: int | None = None, seed: int = 1, target: str = "rating", mean: float | None = None) -> DataFrame:
    """``side, id, bias, factors`` of matrix factorisation by stochastic gradient descent, in strata.

    Users and items are dealt into ``blocks`` each (by default so that a pair of blocks has some ``BLOCK_RATINGS`` ratings; more where a pair would have over ``BLOCK_IDS`` ids). An epoch goes through the strata:
    in one, each block of users meets another block of items, so tasks share no factor and the steps are those of one sequential descent in some order. A task holds the factors of its two blocks.
    Ratings are packed once, by a hash, in pieces of at most ``SGD_PIECE`` that lie by stratum; in each epoch a task's pieces come in another order, each with its ratings in random order, and steps in a piece that share
    no factor are made together. Factors move packed too. A user with very many ratings is met in a part of them at a time. Factors are the same table for all, so their axes agree.
    """
    mean = ratings.agg(F.avg(target)).first()[0] if mean is None else mean
    known = stage(ratings.where(F.col("u").isNotNull() & F.col("i").isNotNull() & F.col(target).isNotNull()).select("u", "i", (F.col(target) - (mean or 0.0)).alias("e")))
    ids = None
    for kind, key in enumerate("ui"):
        own = known.select(F.lit(kind).alias("kind"), F.col(key).alias("id")).distinct()
        ids = own if ids is None else ids.unionByName(own)
    ids = stage(ids)
    blocks = blocks or math.ceil(math.sqrt(known.count() / BLOCK_RATINGS))
    blocks = max(1, blocks, math.ceil(ids.count() / BLOCK_IDS))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    id_piece, rating_piece = ID_PIECE, SGD_PIECE

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, home), (id_,) in _pieces(batches, ["kind", "block"], id_piece):
            draw = np.random.default_rng([seed, kind, home, int(id_[0]) % (1 << 63)]).normal(0, 0.1, (len(id_), rank))
            yield _rows([(kind, home, int(id_[0]), id_.tobytes(), np.zeros(len(id_)).tobytes(), draw.tobytes())], _FACTORS)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (p, q), (u, i, e) in _pieces(batches, ["p", "q"], rating_piece):
            at = np.lexsort((e, i, u))
            u, i, e = u[at], i[at], e[at]
            key = hash((int(u[0]), int(i[0]))) >> 1
            yield _rows([((q - p) % blocks, p, key, u.tobytes(), i.tobytes(), e.tobytes())], _RATINGS)

    laid = ids.select("kind", block("id").alias("block"), "id").repartition("kind", "block").sortWithinPartitions("kind", "block", "id")
    factors = stage(laid.mapInArrow(drawn, "kind int, block int, key long, a binary, e binary, factors binary"))
    discard(ids)
    # Dealt by a hash of the pair, so that a piece has few ratings of one user or item; into as many parts as there are shuffle partitions, so that pieces don't depend on how the rows lie.
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = known.select(block("u").alias("p"), block("i").alias("q"), "u", "i", "e").repartition(parts, "u", "i").sortWithinPartitions("p", "q", F.xxhash64("u", "i", F.lit(seed)), "u", "i", "e")
    pieces = stage_parted(laid.mapInArrow(packed, "stratum int, p int, key long, a binary, b binary, e binary"), "stratum")
    discard(known)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, met = None, [[], []], 0  # the factors of the task at hand, by kind: pieces, then (ids, biases, factors) and the block; and pieces of ratings that it met

        def ready() -> None:
            for k in range(2):
                if isinstance(held[k], list):
                    parts = held[k] or [(0, np.empty(0, np.int64), np.empty(0), np.empty((0, rank)))]
                    held[k] = (parts[0][0], *(np.concatenate(c) for c in list(zip(*parts, strict=True))[1:]))

        def done() -> Iterator[pa.RecordBatch]:
            ready()
            for kind, (home, id_, bias, rows) in enumerate(held):
                for at in range(0, len(id_), id_piece):
                    cut = slice(at, at + id_piece)
                    yield _rows([(kind, home, int(id_[at]), id_[cut].tobytes(), bias[cut].tobytes(), rows[cut].tobytes())], _FACTORS)

        for batch in batches:
            for now, kind, step, home, a, b, e, rows in zip(*(batch.column(c) for c in ("task", "kind", "step", "block", "a", "b", "e", "factors")), strict=True):
                if now.as_py() != task:
                    if task is not None:
                        yield from done()
                    task, held, met = now.as_py(), [[], []], 0
                a, e = np.frombuffer(a.as_buffer(), np.int64), np.frombuffer(e.as_buffer(), np.float64)
                if kind.as_py() < 2:
                    held[kind.as_py()].append((home.as_py(), a, e, np.frombuffer(rows.as_buffer(), np.float64).reshape(-1, rank)))
                    continue
                ready()
                users, items = held
                order = np.random.default_rng([seed, task, step.as_py(), *([met] if met else [])]).permutation(len(e))
                u, i = np.searchsorted(users[1], a), np.searchsorted(items[1], np.frombuffer(b.as_buffer(), np.int64))
                _descend(users[2:], items[2:], u[order], i[order], e[order], rate, reg)
                met += 1
        if task is not None:
            yield from done()

    for epoch in range(epochs):
        for stratum in range(blocks):
            # Block b of users meets block (b + stratum) of items.
            task = F.when(F.col("kind") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - stratum, F.lit(blocks))).cast("int")
            own = factors.select(task.alias("task"), "kind", F.lit(0).cast("long").alias("order"), "key", "block", "a", F.lit(None).cast("binary").alias("b"), "e", "factors")
            here = pieces.where(F.col("stratum") == stratum).select(F.col("p").alias("task"), F.lit(2).alias("kind"), F.xxhash64("key", F.lit(seed), F.lit(epoch)).alias("order"), "key", "p", "a", "b", "e", F.lit(None).cast("binary").alias("factors"))
            tasks = own.unionByName(here.withColumnRenamed("p", "block")).repartitionById(blocks, F.col("task")).sortWithinPartitions("task", "kind", "order", "key", "a").withColumn("step", F.lit(epoch * blocks + stratum))
            after = stage(tasks.mapInArrow(descend, "kind int, block int, key long, a binary, e binary, factors binary"))
            discard(factors)
            factors = after
    discard(pieces)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, a, e, rows in zip(*(batch.column(c) for c in ("kind", "a", "e", "factors")), strict=True):
                a, e, rows = np.frombuffer(a.as_buffer(), np.int64), np.frombuffer(e.as_buffer(), np.float64), np.frombuffer(rows.as_buffer(), np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * rank), pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array([("user", "item")[kind.as_py()]] * len(a)), pa.array(a), pa.array(e), lists], ["side", "id", "bias", "factors"])

    return factors.mapInArrow(unpacked, "side string, id long, bias double, factors array<double>")


def score_factors(requests: DataFrame, factors: DataFrame, ends: tuple[float, float, float], base: DataFrame | None = None, weight: float = 1.0) -> DataFrame:
    """``u, i, score``: the mean, or ``base`` (``u, i, score``), plus ``weight`` times biases and product; what is unknown adds nothing."""
    mean, low, high = ends
    users = factors.where("side = 'user'").select(F.col("id").alias("u"), F.col("factors").alias("p"), F.col("bias").alias("bu"))
    items = factors.where("side = 'item'").select(F.col("id").alias("i"), F.col("factors").alias("q"), F.col("bias").alias("bi"))
    dot = F.aggregate(F.zip_with("p", "q", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    added = F.coalesce("bu", F.lit(0.0)) + F.coalesce("bi", F.lit(0.0)) + F.coalesce(dot, F.lit(0.0))
    rows = requests.select("u", "i") if base is None else base.select("u", "i", F.col("score").alias("_base"))
    start = F.lit(mean) if base is None else F.col("_base")
    return rows.join(users, "u", "left").join(items, "i", "left").select("u", "i", clip(start + weight * added, low, high).alias("score"))


def residual_factors(requests: DataFrame, ratings: DataFrame, bias: tuple, weight: float = 1.0, **how) -> DataFrame:
    """``u, i, score``: the bias model plus ``weight`` times factors by gradient descent on what it leaves."""
    bu, bi, ends = bias
    left = score_bias(ratings, bu, bi, ends).select("u", "i", (F.col("rating") - F.col("score")).alias("e"))
    factors = sgd_factors(left, target="e", mean=0.0, **how)
    return score_factors(requests, factors, ends, score_bias(requests.select("u", "i"), bu, bi, ends), weight)
