"""Online rating prediction over an ordered stream ``(pos, u, i, rating)``.

State is sums and counts of residuals by key: a commutative aggregate, so that the batch form below and the streaming
form in :mod:`skein.streaming.online` end in the same tables. Positions are a column of the source; sampling by position doesn't
depend on how rows are batched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows in a batch. Fixed value.
BATCH_ROWS = 100_000


@dataclass(frozen=True, kw_only=True)
class Scoring:
    """Parameters of the score; ``None`` for a stride switches that side's state off, for the intercept it is the mean. Fitted numbers have no defaults."""

    mean: float
    intercept: float | None
    log_user: float
    log_item: float
    root_user: float
    root_item: float
    user_weight: float
    item_weight: float
    user_shrink: float
    item_shrink: float
    low: float = 0.5
    high: float = 5.0
    item_stride: int | None = 4
    item_phase: int = 2
    user_stride: int | None = 10
    user_phase: int = 0
    scale_items: bool = True
    thresholds: tuple[float, ...] = ()
    values: tuple[float, ...] = field(default=(0.0,))


def batch_of(pos: Column, rows: int = BATCH_ROWS) -> Column:
    return F.floor(pos / rows).cast("long")


def state(rows: DataFrame, key: str, mean: float, stride: int = 1, phase: int = 0, scale: bool = False) -> DataFrame:
    """``key, s, n``: residual sum and count of the sampled rows; ``scale`` weighs each as ``stride`` rows."""
    w = stride if scale else 1
    picked = rows.where(F.col("pos") % stride == phase)
    return picked.groupBy(key).agg(F.sum((F.col("rating") - mean) * w).alias("s"), (F.count("*") * w).alias("n"))


def fallback_user_state(rows: DataFrame, mean: float, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """User state from every second row of each batch, the count beginning anew with the batch."""
    at = F.row_number().over(Window.partitionBy("batch").orderBy("pos")) - 1
    return state(rows.withColumn("batch", batch_of(F.col("pos"), batch_rows)).withColumn("at", at).where("at % 2 = 0"), "u", mean)


def component(n: Column, s: Column, log: float, root: float, weight: float, shrink: float) -> Column:
    """log * ln(1 + n) + root / sqrt(n + 1) + weight * s / (n + shrink), the last only for n > 0."""
    return log * F.log1p(n.cast("double")) + root / F.sqrt(n + 1.0) + F.when(n > 0, weight * s / (n + shrink)).otherwise(0.0)


def segment(u: Column, thresholds: tuple[float, ...], values: tuple[float, ...]) -> Column:
    """Value of the segment that a user id falls into: as many thresholds lie below it. The table is a literal of the plan, bounded by its length."""
    if not thresholds:
        return F.lit(values[0])
    below = F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t < u))
    return F.element_at(F.array(*map(F.lit, values)), below + 1)


def segment_join(rows: DataFrame, segments: DataFrame, key: str = "u", below: float = 0.0) -> DataFrame:
    """``rows`` with ``value``: that of the greatest ``threshold`` of ``segments`` (``threshold, value``; whole numbers, each once) below the key, else ``below``; a null key has ``below``.

    For tables of segments of any length. Thresholds bound intervals, which are cut at multiples of a power of two, so that there are at most twice as many pieces as segments and an interval's pieces
    and the keys inside join on equal buckets; the interval is then the one whose bounds hold the key. Spark picks the join by the sizes of both sides.
    """
    least, most, n = segments.agg(F.min("threshold"), F.max("threshold"), F.count("*")).first()
    if not n:
        return rows.withColumn("value", F.lit(below))
    bits = max(0, ((most - least) // n).bit_length())
    # Buckets by rank of thresholds would need an order of all; these need none. Keys beyond the ends fall into the last bucket or none.
    bucket = lambda c: F.shiftright(F.least(c, F.lit(most + 1)) - F.lit(least), bits)
    after = F.lead("threshold").over(Window.partitionBy("_part").orderBy("threshold"))
    # The next threshold, found within parts of neighbouring buckets; the last of a part ends at the first of a later one.
    parts = segments.select(F.col("threshold").cast("long"), "value", F.shiftright(F.col("threshold") - F.lit(least), bits + 12).alias("_part"))
    firsts = parts.groupBy("_part").agg(F.min("threshold").alias("first"))
    firsts = firsts.select("_part", F.lead("first").over(Window.orderBy("_part")).alias("next"))  # one row for each 4,096 buckets
    bounds = parts.withColumn("after", after).join(firsts, "_part").select("threshold", "value", F.coalesce("after", "next", F.lit(most + 1)).alias("_end"))
    # An interval holds the keys from threshold + 1 to _end; the last one has no end.
    pieces = bounds.select(
        F.col("threshold").alias("_start"), F.when(F.col("threshold") < most, F.col("_end")).alias("_end"), "value", F.explode(F.sequence(bucket(F.col("threshold") + 1), bucket(F.col("_end")))).alias("_bucket"),
    )
    keyed = rows.withColumn("_bucket", bucket(F.col(key).cast("long"))).alias("r")
    inside = (F.col("r._bucket") == F.col("s._bucket")) & (F.col(f"r.{key}") > F.col("s._start")) & (F.col("s._end").isNull() | (F.col(f"r.{key}") <= F.col("s._end")))
    return keyed.join(pieces.alias("s"), inside, "left").select(*[F.col(f"r.{c}") for c in rows.columns], F.coalesce("s.value", F.lit(below)).alias("value"))


def score(requests: DataFrame, users: DataFrame | None, items: DataFrame | None, p: Scoring, known_users: int | None = None, known_items: int | None = None) -> DataFrame:
    """``requests`` with ``score``. No state at all, or an id out of range, gives the mean."""
    if users is None and items is None:
        return requests.withColumn("score", F.lit(p.mean))
    out, total = requests, F.lit(p.mean if p.intercept is None else p.intercept)
    for side, table, args in (("u", users, (p.log_user, p.root_user, p.user_weight, p.user_shrink)), ("i", items, (p.log_item, p.root_item, p.item_weight, p.item_shrink))):
        if table is not None:
            # Scored once for each key, before the join.
            keyed = table.select(side, component(F.col("n"), F.col("s"), *args).alias(f"_{side}"))
            none = component(F.lit(0), F.lit(0.0), *args)
            out, total = out.join(keyed, side, "left"), total + F.coalesce(F.col(f"_{side}"), none)
    total = total + segment(F.col("u"), p.thresholds, p.values)
    inside = F.lit(True)
    for side, n in (("u", known_users), ("i", known_items)):
        if n is not None:
            inside = inside & (F.col(side) >= 0) & (F.col(side) < n)
    clipped = F.greatest(F.lit(p.low), F.least(F.lit(p.high), total))
    return out.withColumn("score", F.when(inside, clipped).otherwise(p.mean)).select(*requests.columns, "score")


def fit_states(rows: DataFrame, p: Scoring) -> tuple[DataFrame | None, DataFrame | None]:
    users = state(rows, "u", p.mean, p.user_stride, p.user_phase) if p.user_stride else None
    items = state(rows, "i", p.mean, p.item_stride, p.item_phase, p.scale_items) if p.item_stride else None
    return users, items


def fallback_score(requests: DataFrame, users: DataFrame, items: DataFrame, mean: float, low: float, high: float) -> DataFrame:
    """mean + 0.8 s / (n + 5) of the user + 0.9 s / (n + 3) of the item, clipped. Fixed values."""
    u = users.select("u", (0.8 * F.col("s") / (F.col("n") + 5)).alias("_u"))
    i = items.select("i", (0.9 * F.col("s") / (F.col("n") + 3)).alias("_i"))
    total = F.lit(mean) + F.coalesce("_u", F.lit(0.0)) + F.coalesce("_i", F.lit(0.0))
    return requests.join(u, "u", "left").join(i, "i", "left").withColumn("score", F.greatest(F.lit(low), F.least(F.lit(high), total))).drop("_u", "_i")


def shrunken(requests: DataFrame, tables: list[tuple[str, DataFrame, float, float]], mean: float, low: float, high: float) -> DataFrame:
    """mean + the sum of weight * s / (n + shrink) over (key, state, weight, shrink): the item-only and bias-only models and multiple shrinkage."""
    out, total = requests, F.lit(mean)
    for at, (key, table, weight, shrink) in enumerate(tables):
        out = out.join(table.select(key, (weight * F.col("s") / (F.col("n") + shrink)).alias(f"_{at}")), key, "left")
        total = total + F.coalesce(F.col(f"_{at}"), F.lit(0.0))
    return out.withColumn("score", F.greatest(F.lit(low), F.least(F.lit(high), total))).select(*requests.columns, "score")


def moments(rows: DataFrame, key: str, mean: float) -> DataFrame:
    """``key, n, s1, s2, s3``: power sums of residuals."""
    e = F.col("rating") - mean
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(e).alias("s1"), F.sum(e * e).alias("s2"), F.sum(e * e * e).alias("s3"))


@dataclass(frozen=True, kw_only=True)
class MomentScoring:
    """Parameters of :func:`moment_score`; fitted numbers have no defaults. Dictionaries are by side, ``u`` and ``i``."""

    mean: float
    intercept: float
    #: Of the terms that a side has by itself, in the order of :func:`moment_terms`.
    own: dict[str, tuple[float, ...]]
    #: (least count, greatest count or None, weight) of the steps by a key's count.
    steps: dict[str, tuple[tuple[int, int | None, float], ...]]
    #: Added for a key without rows, beside its steps and the root term.
    absent: dict[str, float]
    #: Of products of both sides, by their letters: "bm" is the user's b times the item's m; and of the difference of the log counts.
    pairs: dict[str, float]
    log_difference: float
    #: Ends and weights of the vectors' segments, and a constant beside them.
    bounds: tuple[int, ...] = ()
    segment_weights: tuple[float, ...] = ()
    segment_constant: float = 0.0
    #: Shrinkage and damping of the biases, and their rounds.
    user_shrink: float
    item_shrink: float
    damping: tuple[float, float]
    rounds: int = 4
    #: Rows below which the biases alone score.
    small: int = 1000
    low: float = 0.5
    high: float = 5.0


def moment_terms() -> tuple[Column, ...]:
    """The terms of one side: b (bias), l (log count), r (inverse root count), m (mean), v (variance), s (deviation), t (signed cube root of the third central moment), and their products."""
    b, log, r, m, v, s, t = map(F.col, "blrmvst")
    return (b, log, r, b * b, F.abs(b), m, v, m * m, F.abs(m), s, log * log, b * m, m * v, m * r, b * r, t, t * t, t * m, t * r, t * log)


def moment_features(sums: DataFrame, key: str, bias: DataFrame, p: MomentScoring) -> DataFrame:
    """``key`` and, each with its letter in front: b, l, m, v, s, t as in :func:`moment_terms` and own (the side's part of the score), from power sums (:func:`moments`)."""
    m1, m2, m3 = (F.col(c) / F.col("n") for c in ("s1", "s2", "s3"))
    third = m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1
    x = sums.join(bias.withColumnRenamed(f"b{key}", "b"), key).withColumns({"l": F.log1p("n"), "r": 1 / F.sqrt(F.col("n") + 1.0), "m": m1, "v": F.greatest(F.lit(0.0), m2 - m1 * m1), "t": F.signum(third) * F.cbrt(F.abs(third))})
    x = x.withColumn("s", F.sqrt("v"))
    total = sum((w * c for w, c in zip(p.own[key], moment_terms(), strict=True)), F.lit(0.0))
    for least, most, w in p.steps[key]:
        total = total + F.when((F.col("n") >= least) & (F.lit(True) if most is None else F.col("n") <= most), w).otherwise(0.0)
    return x.select(key, *[F.col(c).alias(f"{key}{c}") for c in "blmvst"], total.alias(f"{key}own"))


def moment_score(
    requests: DataFrame, rows: DataFrame, p: MomentScoring, known_users: int | None = None, known_items: int | None = None, sums: dict[str, DataFrame] | None = None
) -> DataFrame:
    """``requests`` with ``score`` from both sides' moments and biases over ``rows``; the biases alone below ``p.small`` rows, the mean without rows or for an id out of range.

    ``sums`` are the sides' power sums where a stream has kept them. Requests with vectors ``pv`` and ``qv`` that are long enough have products of their segments added.
    """
    n = rows.count()
    if not n:
        return requests.withColumn("score", F.lit(p.mean))
    from skein.operators.models import bias_tables

    bu, bi, _ = bias_tables(rows, p.user_shrink, p.rounds, p.item_shrink, p.damping, p.mean)
    sides = [moment_features(sums[key] if sums else moments(rows, key, p.mean), key, bias, p) for key, bias in (("u", bu), ("i", bi))]
    x = requests
    if vectors := bool(p.bounds) and {"pv", "qv"} <= set(requests.columns):
        # Before the joins, so that they move one number a row and not two vectors.
        products = p.segment_constant + segment_dot(list(p.bounds), list(p.segment_weights))
        x = x.withColumn("_products", F.when((F.size("pv") >= p.bounds[-1]) & (F.size("qv") >= p.bounds[-1]), products).otherwise(0.0))
    for key, side in zip("ui", sides, strict=True):
        x = x.join(side, key, "left")
    # A key without rows: count 0, so its root term is its weight, and its steps are those from 0 on.
    cold = {k: p.absent[k] + p.own[k][2] + sum(w for least, _, w in p.steps[k] if least == 0) for k in "ui"}
    has = {key: {c: F.coalesce(F.col(f"{key}{c}"), F.lit(cold[key] if c == "own" else 0.0)) for c in ("b", "l", "m", "v", "s", "t", "own")} for key in "ui"}
    u, i = has["u"], has["i"]
    total = p.intercept + u["own"] + i["own"] + p.log_difference * (u["l"] - i["l"])
    for letters, w in p.pairs.items():
        total = total + w * u[letters[0]] * i[letters[1]]
    if vectors:
        total = total + F.col("_products")
    if n < p.small:
        total = F.lit(p.mean) + u["b"] + i["b"]
    inside = F.lit(True)
    for side, known in (("u", known_users), ("i", known_items)):
        if known is not None:
            inside = inside & F.col(side).between(0, known - 1)
    clipped = F.greatest(F.lit(p.low), F.least(F.lit(p.high), total))
    return x.withColumn("score", F.when(F.coalesce(inside, F.lit(False)), clipped).otherwise(p.mean)).select(*requests.columns, "score")


def dot(p: str = "pv", q: str = "qv", first: int = 1, length: int | None = None) -> Column:
    """Product of two vectors, or of a slice of them, in double."""
    a, b = (F.slice(c, first, length) if length else F.col(c) for c in (p, q))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def segment_dot(bounds: list[int], weights: list[float]) -> Column:
    """Products of consecutive slices of the vectors, each with its weight."""
    total, at = F.lit(0.0), 1
    for end, w in zip(bounds, weights, strict=True):
        total = total + w * dot(first=at, length=end - at + 1)
        at = end + 1
    return total


def linear_head(vector: str, coefficients: list[float]) -> Column:
    return F.aggregate(F.zip_with(F.col(vector), F.array(*map(F.lit, coefficients)), lambda x, c: x.cast("double") * c), F.lit(0.0), lambda t, x: t + x)


def mlp_head(rows: DataFrame, key: str, vector: str, w, hidden, bias, out) -> DataFrame:
    """``key, head``: w x + sum of out_h * relu(hidden_h x + bias_h), as matrix products over Arrow batches."""
    w, hidden, bias, out = (np.asarray(a, float) for a in (w, hidden, bias, out))

    @F.pandas_udf("double")
    def head(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float)[:, : len(w)]
        return pd.Series(x @ w + np.maximum(x @ hidden.T + bias, 0) @ out)

    return rows.select(key, head(vector).alias("head"))


def factor_user(users: DataFrame, high: DataFrame, low: DataFrame, n_users: int, n_high: int) -> DataFrame:
    """``u, prior``: sum over r of A[floor(u H / U), r] B[u mod L, r]; ``high``: ``h, a``; ``low``: ``l, b``, arrays."""
    n_low = low.count()
    keyed = users.select("u", F.floor(F.col("u") * n_high / F.lit(n_users)).cast("long").alias("h"), (F.col("u") % n_low).alias("l"))
    both = keyed.join(high, "h").join(low, "l")
    return both.select("u", F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x).alias("prior"))
