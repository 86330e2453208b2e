"""Model-fitting blocks: normal equations, bins and tables, back-fitting, segmentation, screening, bases."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.graph import ranked
from skein.stage import stage


def gram(rows: DataFrame, columns: list[str], target: str) -> DataFrame:
    """``a, b, value``: all sums of products of the columns (a <= b) and with the target, from one aggregation."""
    names = [*columns, target]
    pairs = [(x, y) for k, x in enumerate(names) for y in names[k:]]
    sums = rows.agg(*[F.sum(F.col(x) * F.col(y)).alias(f"g{n}") for n, (x, y) in enumerate(pairs)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"g{n}").alias("value")) for n, (x, y) in enumerate(pairs)])))


def ridge(rows: DataFrame, columns: list[str], target: str, rho: float) -> dict[str, float]:
    """Coefficients of (X'X + rho I) c = X'y; the sums come from Spark, the small system is solved here."""
    return solve_ridge(gram_sums(rows, columns, target), columns, target, rho)


def gram_sums(rows: DataFrame, columns: list[str], target: str) -> dict[tuple[str, str], float]:
    return {(r["a"], r["b"]): r["value"] for r in gram(rows, columns, target).collect()}  # (k + 1)(k + 2) / 2 numbers


def solve_ridge(found: dict[tuple[str, str], float], columns: list[str], target: str, rho: float) -> dict[str, float]:
    at = lambda x, y: found.get((x, y), found.get((y, x)))
    x = np.array([[at(a, b) for b in columns] for a in columns]) + rho * np.eye(len(columns))
    return dict(zip(columns, np.linalg.solve(x, np.array([at(a, target) for a in columns])), strict=True))


def safe_mean(s: Column, n: Column, shrink: float) -> Column:
    return F.when(n > 0, s / (n + shrink)).otherwise(0.0)


def rich_stats(rows: DataFrame, key: str, mean: float) -> DataFrame:
    """``key, n, s, s2, high, low``: residual sums and counts of ratings from 4 up and to 2 down."""
    e = F.col("rating") - mean
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(e).alias("s"), F.sum(e * e).alias("s2"), F.count_if(F.col("rating") >= 4).alias("high"), F.count_if(F.col("rating") <= 2).alias("low"))


def neighbour_means(rows: DataFrame, key: str, other: str, mean: float, shrink: float) -> DataFrame:
    """``key, m``: mean shrunken bias of the other side's keys that this key's rows name."""
    bias = rows.groupBy(other).agg((F.sum(F.col("rating") - mean) / (F.count("*") + shrink)).alias("b"))
    return rows.join(bias, other).groupBy(key).agg(F.avg("b").alias("m"))


def uniform_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """Bins of equal width, ends clamped; one bin where low equals high."""
    if high <= low:
        return F.lit(0)
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), ((x - low) * bins / (high - low)).cast("int")))


def rank_bin(rows: DataFrame, key: str, bins: int) -> DataFrame:
    """``rows`` with ``bin``: floor(rank * bins / count) by a unique key; ranks are taken within ranges."""
    placed = ranked(rows, key, "_at")
    n = rows.count()
    return placed.withColumn("bin", F.floor(F.col("_at") * bins / F.lit(max(n, 1))).cast("int")).drop("_at")


def combine_bins(bins: list[Column], sizes: list[int]) -> Column:
    """Mixed-radix index; the first bin varies fastest."""
    out, step = F.lit(0), 1
    for b, n in zip(bins, sizes, strict=True):
        out, step = out + b * step, step * n
    return out


def hash_bin(key: Column, a: int, b: int, modulus: int, bins: int) -> Column:
    """(key a + b) mod modulus mod bins: arithmetic that other engines share."""
    return F.pmod(F.pmod(key * a + b, F.lit(modulus)), F.lit(bins))


def pair_hash_bin(u: Column, i: Column, a: int, b: int, modulus: int, bins: int) -> Column:
    """(u a + i b) mod modulus mod bins: one bin for a pair of ids."""
    return F.pmod(F.pmod(u * a + i * b, F.lit(modulus)), F.lit(bins))


def multi_hash_bins(key: Column, multipliers: list[int], modulus: int, bins: int) -> list[Column]:
    """A bin from each multiplier, so that ids which share one bin hardly share all."""
    return [hash_bin(key, a, k, modulus, bins) for k, a in enumerate(multipliers)]


def table(rows: DataFrame, bin_column: str, residual: str, shrink: float) -> DataFrame:
    """``bin, value``: shrunken means of the residual."""
    return rows.groupBy(F.col(bin_column).alias("bin")).agg((F.sum(residual) / (F.count("*") + shrink)).alias("value"))


def backfit(rows: DataFrame, bins: list[str], target: str, shrink: float, rounds: int) -> list[DataFrame]:
    """Additive tables, one for each bin column, each fitted in turn to what the others leave."""
    tables: list[DataFrame | None] = [None] * len(bins)
    for _ in range(rounds):
        for k, own in enumerate(bins):
            rest, left = rows, F.col(target)
            for j, name in enumerate(bins):
                if j != k and tables[j] is not None:
                    rest = rest.join(tables[j].select(F.col("bin").alias(name), F.col("value").alias(f"_{j}")), name, "left")
                    left = left - F.coalesce(F.col(f"_{j}"), F.lit(0.0))
            tables[k] = stage(table(rest.withColumn("_left", left), own, "_left", shrink))
    return tables


def backfit_until(rows: DataFrame, bins: list[str], target: str, shrink: float, patience: int, least: float = 0.0, most: int = 200) -> tuple[list[DataFrame], list[float]]:
    """Like :func:`backfit`, round by round until ``patience`` rounds in turn lower the error by less than ``least``; the best round's tables, and all rounds' errors."""
    rows = stage(rows.select(*bins, F.col(target).alias("_e")))
    tables: list[DataFrame | None] = [None] * len(bins)
    best, kept, errors, idle = float("inf"), [], [], 0
    while idle < patience and len(errors) < most:
        for k, own in enumerate(bins):
            left = _without(rows, bins, [t if j != k else None for j, t in enumerate(tables)])
            tables[k] = stage(table(left, own, "_left", shrink))
        error = _without(rows, bins, tables).agg(F.sqrt(F.avg(F.col("_left") * F.col("_left")))).first()[0]
        errors.append(error)
        idle = 0 if error < best - least else idle + 1
        if error < best - least:
            best, kept = error, list(tables)
    return kept, errors


def _without(rows: DataFrame, bins: list[str], tables: list[DataFrame | None]) -> DataFrame:
    """``rows`` with ``_left``: what the tables leave of ``_e``."""
    left = F.col("_e")
    for j, (name, t) in enumerate(zip(bins, tables, strict=True)):
        if t is not None:
            rows = rows.join(t.select(F.col("bin").alias(name), F.col("value").alias(f"_{j}")), name, "left")
            left = left - F.coalesce(F.col(f"_{j}"), F.lit(0.0))
    return rows.withColumn("_left", left)


def greedy_tables(
    rows: DataFrame, candidates: list[str | tuple[str, str]], target: str, shrink: float | list[float], budget: int, least_gain: float, idle_rounds: int = 1, repeat: bool = False
) -> list[str] | list[tuple[tuple[str, ...], float]]:
    """Tables taken one by one, each the one that lowers the squared error most, within a budget of bins; stops after ``idle_rounds`` rounds that gain too little.

    A candidate is a bin column, or a pair of them: then its bins are the pairs that occur. With a list of shrinkages each candidate is tried with all, and (columns, shrinkage)
    is returned; ``repeat`` lets a candidate be taken again. A round measures all candidates in one aggregation of the rows, exploded by candidate.
    """
    shrinks = shrink if isinstance(shrink, list) else [shrink]
    columns = {c if isinstance(c, str) else " x ".join(c): (c,) if isinstance(c, str) else tuple(c) for c in candidates}
    bins = sorted({n for c in columns.values() for n in c})
    rows = rows.select(*bins, F.col(target).cast("double").alias("_e"))
    chosen: list[tuple[str, float]] = []
    idle = 0
    while idle < idle_rounds:
        rest = [c for c in columns if repeat or c not in [n for n, _ in chosen]]
        if not rest:
            break
        of = lambda c: F.array_join(F.array(*[F.col(n).cast("string") for n in columns[c]]), " ")
        long = rows.select("_e", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), of(c).alias("bin")) for c in rest])).alias("x")).select("_e", "x.*")
        sums = long.groupBy("c", "bin").agg(F.sum("_e").alias("s"), F.count("*").alias("n"))
        gains = []
        for k, lam in enumerate(shrinks):
            value = F.col("s") / (F.col("n") + lam)
            gains.append(F.sum(2 * value * F.col("s") - value * value * F.col("n")).alias(f"g{k}"))
        found = sums.groupBy("c").agg(F.count("*").alias("bins"), *gains).collect()  # a row a candidate
        fitting = [(r[f"g{k}"], r["c"], lam, r["bins"]) for r in found for k, lam in enumerate(shrinks) if r["bins"] <= budget]
        if not fitting:
            break
        gain, name, lam, used = max(fitting)
        if gain < least_gain:
            idle += 1  # the next round would find the same
            continue
        idle = 0
        chosen.append((name, lam))
        budget -= used
        own = of(name)
        t = stage(rows.groupBy(own.alias("_bin")).agg((F.sum("_e") / (F.count("*") + lam)).alias("_value")))
        rows = stage(rows.withColumn("_bin", own).join(t, "_bin").withColumn("_e", F.col("_e") - F.col("_value")).drop("_value", "_bin"))
    return [(columns[n], lam) for n, lam in chosen] if isinstance(shrink, list) else [n for n, _ in chosen]


def segments(points: list[tuple[float, float, float]], count: int) -> tuple[list[float], list[float]]:
    """Thresholds and values of the best piecewise constant fit to (x, weight, mean), exact for any order of means; an x between two segments belongs to the later one.

    ``points`` are distinct x in order. The best last cut doesn't move monotonically with the end where means aren't sorted, so halving the cuts isn't exact; functional pruning is: for each number of segments
    a candidate cut is kept while there is a value of the last segment for which no other cut is better, which is two intervals at most as kept here. A few dozen candidates stay, so time is in proportion to
    points; all numbers of segments advance together, point by point.
    """
    x, w, m = (np.array(c, float) for c in zip(*points, strict=True))
    n = len(x)
    count = min(count, n)
    sums = np.stack([np.concatenate([[0.0], np.cumsum(v)]) for v in (w, w * m, w * m * m)])
    slack, rows, width, used = 1e-12 * max(1.0, sums[2, -1]), np.arange(count), 32, 1
    # Of each candidate: place, error before it, intervals (low, high, low, high), and the sums up to it.
    empty = np.array([0, np.inf, -np.inf, np.inf, np.inf, -np.inf, 0, 0, 0])[:, None, None]
    held = np.broadcast_to(empty, (9, count, width)).copy()
    held[1, 0, 0] = 0
    back, before = np.zeros((count, n + 1), np.int32), np.full(count, np.inf)
    with np.errstate(invalid="ignore", divide="ignore"):
        for b in range(1, n + 1):
            now = held[:, :, :used]
            weight = sums[0, b] - now[6]
            mean = (sums[1, b] - now[7]) / weight
            error = now[1] + (sums[2, b] - now[8]) - mean * mean * weight
            best = error.argmin(axis=1)
            reached = error[rows, best]
            back[:, b] = now[0, rows, best]
            before[1:] = reached[:-1]
            new = held[:, :, used] if used < width else np.empty((9, count))
            new[:] = empty[:, :, 0]
            # Values of the last segment for which a candidate is no worse than a new one here: about its mean, as far as its error leaves room.
            reach = np.sqrt((before[:, None] - error + slack) / weight)
            low, high = mean - reach, mean + reach
            for k in (2, 4):
                np.maximum(now[k], low, out=now[k])
                np.minimum(now[k + 1], high, out=now[k + 1])
            dead = ~((now[2] <= now[3]) | (now[4] <= now[5]))
            now[1][dead] = np.inf
            # A new candidate is left what lies outside the widest of these and those that overlap its ends.
            reach = np.where(dead | np.isnan(reach), -1.0, reach)
            widest = reach.argmax(axis=1)
            some = reach[rows, widest] >= 0
            left, right = (np.where(some, side[rows, widest], end) for side, end in ((low, np.inf), (high, -np.inf)))
            over = [(reach >= 0) & (low <= end[:, None]) & (high >= end[:, None]) for end in (left, right)]
            left = np.minimum(left, np.where(over[0], low, np.inf).min(axis=1))
            right = np.maximum(right, np.where(over[1], high, -np.inf).max(axis=1))
            new[3], new[4], new[5] = np.where(some, left, np.inf), np.where(some, right, np.inf), np.where(some, np.inf, -np.inf)
            new[0], new[1], new[6:] = b, before, sums[:, b, None]
            if used == width:
                alive = np.isfinite(held[1])
                most = int(alive.sum(axis=1).max(initial=0))
                order = np.argsort(~alive, axis=1, kind="stable")[:, :most]
                width = width * 2 if 2 * most > width else width
                packed = np.broadcast_to(empty, (9, count, width)).copy()
                packed[:, :, :most] = np.take_along_axis(held, order[None], axis=2)
                held, used = packed, most
                held[:, :, used] = new
            used += 1
    cuts, b = [], n
    for k in reversed(range(count)):
        cuts.append((int(back[k, b]), b))
        b = cuts[-1][0]
    cuts.reverse()
    values = [float((sums[1, b] - sums[1, a]) / max(sums[0, b] - sums[0, a], 1e-300)) for a, b in cuts]
    return [float(x[b - 1]) for _, b in cuts[:-1]], values


def segment_points(rows: DataFrame, key: str, residual: str, width: int = 1) -> DataFrame:
    """``x, w, m`` of each bin of ``width`` ids: what :func:`segments` takes."""
    x = F.floor(F.col(key) / width) * width + (width - 1)
    return rows.groupBy(x.cast("double").alias("x")).agg(F.count("*").cast("double").alias("w"), F.avg(residual).alias("m"))


#: Distinct ids that segments are fitted to on the driver, point by point; more are put into so many bins of equal width.
MOST_BINS = 1_000_000


def bounded_points(rows: DataFrame, key: str, residual: str) -> list[tuple[float, float, float]]:
    """Points of :func:`segment_points` in order: each id by itself, or, over ``MOST_BINS`` ids from the least to the greatest, bins as wide as it takes."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None:
        raise ValueError("no rows to segment")
    width = (high - low) // MOST_BINS + 1
    shifted = rows.withColumn("_id", F.col(key) - low)
    return [(x + low, w, m) for x, w, m in segment_points(shifted, "_id", residual, width).orderBy("x").collect()]  # MOST_BINS rows at most


def mixed_segments(rows: DataFrame, residual: str, users: int, items: int, rounds: int = 2, widths: tuple[int, int] = (1, 1)) -> tuple[tuple, tuple]:
    """Segmentations of user and item ids, in bins of ``widths`` ids, each fitted to what the other leaves, in turns."""
    from skein.operators.online import segment

    found: dict[str, tuple] = {"u": ([], [0.0]), "i": ([], [0.0])}
    for _ in range(rounds):
        for key, other, n, width in (("u", "i", users, widths[0]), ("i", "u", items, widths[1])):
            left = rows.withColumn("_left", F.col(residual) - segment(F.col(other), tuple(found[other][0]), tuple(found[other][1])))
            points = segment_points(left, key, "_left", width).orderBy("x").collect()
            found[key] = segments([tuple(p) for p in points], n)
    return found["u"], found["i"]


def screen(rows: DataFrame, vectors: dict[str, str], residual: str, keep: int, products: dict[str, tuple[str, str]] | None = None, scaled: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """``kind, dim, strength``: the vector components (and squares) most correlated with the residual: abs(cov) / sd.

    ``products`` of two vectors add their components' products, and these without sign (``abs_`` before the kind); ``scaled``: a vector times a number.
    """
    parts = None
    made = {k: F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")) for k, (a, b) in (products or {}).items()}
    made |= {f"abs_{k}": F.transform(v, lambda x: F.abs(x)) for k, v in list(made.items())}
    times = lambda vector, number: F.transform(vector, lambda x: x.cast("double") * F.col(number))
    made |= {k: times(*both) for k, both in (scaled or {}).items()}
    for kind, column in made.items():
        one = rows.select(F.col(residual).alias("e"), F.posexplode(column).alias("dim", "x")).select(F.lit(kind).alias("kind"), "dim", "e", "x")
        parts = one if parts is None else parts.unionByName(one)
    for kind, column in vectors.items():
        long = rows.select(F.col(residual).alias("e"), F.posexplode(column).alias("dim", "x"))
        for name, x in ((kind, F.col("x").cast("double")), (f"{kind}2", F.col("x").cast("double") ** 2)):
            one = long.select(F.lit(name).alias("kind"), "dim", "e", x.alias("x"))
            parts = one if parts is None else parts.unionByName(one)
    sums = parts.groupBy("kind", "dim").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum("e").alias("se"), F.sum(F.col("x") * F.col("e")).alias("sxe"))
    cov = F.col("sxe") / F.col("n") - F.col("sx") * F.col("se") / (F.col("n") * F.col("n"))
    var = F.col("sxx") / F.col("n") - F.pow(F.col("sx") / F.col("n"), F.lit(2))
    strength = F.when(var > 1e-12, F.abs(cov) / F.sqrt(var)).otherwise(0.0)
    return sums.select("kind", "dim", strength.alias("strength")).orderBy(F.desc("strength"), "kind", "dim").limit(keep)


def fourier_basis(x: Column, period: float, frequencies: list[int]) -> dict[str, Column]:
    angle = x * (2 * math.pi / period)
    return {f"{f}{k}": g(angle * k) for k in frequencies for f, g in (("sin", F.sin), ("cos", F.cos))}


def chebyshev_basis(x: Column, low: float, high: float, degree: int) -> dict[str, Column]:
    """T_k(t) with ``low``..``high`` scaled to -1..1, as polynomials, T_k+1 = 2 t T_k - T_k-1, so that they hold beyond that range too."""
    t = 2 * (x - low) / (high - low) - 1
    found = [F.lit(1.0), t]
    while len(found) <= degree:
        found.append(2 * t * found[-1] - found[-2])
    return {f"t{k}": c for k, c in enumerate(found[: degree + 1])}


def product_basis(first: dict[str, Column], second: dict[str, Column]) -> dict[str, Column]:
    """Two axes' bases and all products of one with the other."""
    return {f"a_{k}": c for k, c in first.items()} | {f"b_{k}": c for k, c in second.items()} | {f"{k}_{m}": c * d for k, c in first.items() for m, d in second.items()}


def frequency_points(rows: DataFrame, key: str, residual: str, size: int, most: int = 1 << 22) -> np.ndarray:
    """What :func:`top_frequencies` takes: for each of ``size`` ids, in order, the mean residual times the root of the id's rows over their mean; 0 for ids without rows.

    Above ``most`` ids, so many bins of equal width take their place: frequencies up to half of ``most`` are found.
    """
    bins = min(size, most)
    sums = rows.groupBy(F.expr(f"{key} * {bins} div {size}").alias("x")).agg(F.avg(residual).alias("m"), F.count("*").alias("n"))
    x, m, n = (c.to_numpy() for c in sums.where("x is not null").toArrow().columns)  # bins rows at most
    points = np.zeros(bins)
    points[x] = np.nan_to_num(m.astype(float)) * np.sqrt(n / (n.sum() / max(bins, 1)))
    return points


def top_frequencies(points: np.ndarray, keep: int) -> list[int]:
    """Frequencies of largest amplitude in a series of means."""
    amplitude = np.abs(np.fft.rfft(points))
    amplitude[0] = 0
    return [int(k) for k in np.argsort(-amplitude, kind="stable")[:keep]]


def boosted(rows: DataFrame, columns: list[str], target: str, rounds: int = 20, depth: int = 4, seed: int = 1):
    """Gradient-boosted regression trees on the columns; returns the fitted model with its assembler."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    trees = GBTRegressor(featuresCol="_x", labelCol=target, maxIter=rounds, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x"), trees]).fit(rows)
