"""Fitted heads and priors: designs from counts and sums, ridge over vectors, pair and MLP heads, factorised id tables.

What is fitted are sums over all rows, made by Spark: a driver sees matrices of the size of the design, or a gradient.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators import fit
from skein.stage import discard, stage


def terms(user: tuple[str, str], item: tuple[str, str], user_shrinks: list[float], item_shrinks: list[float]) -> dict[str, Column]:
    """The design's columns by name, from (sum, count) columns of either side: a constant, log counts and their squares, inverse roots, and a shrunken mean for each shrinkage."""
    out = {"one": F.lit(1.0)}
    sides = {side: (F.coalesce(F.col(s), F.lit(0.0)), F.coalesce(F.col(n), F.lit(0)).cast("double")) for side, (s, n) in (("u", user), ("i", item))}
    out |= {f"log_{side}": F.log1p(n) for side, (_, n) in sides.items()}
    out |= {f"log2_{side}": F.log1p(n) * F.log1p(n) for side, (_, n) in sides.items()}
    out |= {f"root_{side}": 1 / F.sqrt(n + 1) for side, (_, n) in sides.items()}
    for side, shrinks in (("u", user_shrinks), ("i", item_shrinks)):
        s, n = sides[side]
        out |= {f"mean_{side}_{k}": fit.safe_mean(s, n, shrink) for k, shrink in enumerate(shrinks)}
    return out


def ridge_grid(rows: DataFrame, columns: list[str], target: str, rhos: list[float], low: float, high: float, offset: str | None = None, held: DataFrame | None = None) -> tuple[DataFrame, dict[float, dict[str, float]]]:
    """``rho, rmse`` (of the clipped prediction) and the coefficients for each rho: one pass for the sums, one for all errors. ``offset`` is added to predictions; errors are those on ``held``, or else on the rows fitted."""
    found = fit.gram_sums(rows, columns, target)
    solved = {rho: fit.solve_ridge(found, columns, target, rho) for rho in rhos}
    base = F.col(offset) if offset else F.lit(0.0)
    wanted = F.col(target) + base
    errors = []
    for rho, c in solved.items():
        p = base
        for name, v in c.items():
            p = p + F.col(name) * v
        errors.append(F.struct(F.lit(rho).alias("rho"), F.pow(F.greatest(F.lit(low), F.least(F.lit(high), p)) - wanted, F.lit(2)).alias("e")))
    grid = (rows if held is None else held).select(F.explode(F.array(*errors)).alias("x")).groupBy("x.rho").agg(F.sqrt(F.avg("x.e")).alias("rmse"))
    return grid, solved


def vector_gram(rows: DataFrame, vectors: list[str], target: str, weight: str | None = None, made: Callable[..., np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Of a constant and the vectors' components: the weighted matrix of their products, its products with the target, and the sum of weights.

    Each task adds up its matrices; one matrix a task is summed by cells, so the driver gets one. ``made`` gives other components from the vectors of some rows at a time, a matrix for each.
    """
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("value", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [batch.column(v).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for v in vectors]
            x = np.concatenate([np.ones((batch.num_rows, 1)), *(parts if made is None else [made(*parts)])], axis=1)
            y = batch.column("_y").to_numpy(zero_copy_only=False)
            both = np.concatenate([x, y[:, None]], axis=1)
            part = (both * batch.column("_w").to_numpy(zero_copy_only=False)[:, None]).T @ both
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=schema.names)

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = rows.select(*vectors, F.col(target).cast("double").alias("_y"), w.alias("_w")).mapInArrow(run, schema)
    found = {r["cell"]: r["value"] for r in cells.groupBy("cell").agg(F.sum("value").alias("value")).collect()}  # as many as the matrix has cells
    if not found:
        raise ValueError("no rows to fit")
    size = round(len(found) ** 0.5)
    whole = np.array([found[k] for k in range(size * size)]).reshape(size, size)
    return whole[:-1, :-1], whole[:-1, -1], float(whole[0, 0])


def centred_ridge(gram: np.ndarray, product: np.ndarray, weight: float, dims: list[int], rho: float) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of the components ``dims``, about their weighted means, weights scaled to a mean of 1 by the caller."""
    at = np.array(dims) + 1
    mean, centre = gram[0, at] / weight, product[0] / weight
    a = gram[np.ix_(at, at)] - weight * np.outer(mean, mean)
    b = product[at] - weight * mean * centre
    c = np.linalg.solve(a + rho * np.eye(len(dims)), b)
    return float(centre - mean @ c), c


def strongest(gram: np.ndarray, product: np.ndarray, weight: float, keep: int) -> list[int]:
    """Components with the greatest absolute covariance with the target over their deviation."""
    mean = gram[0, 1:] / weight
    cov = product[1:] - mean * product[0]
    var = np.diag(gram)[1:] - weight * mean**2 + 1e-12
    return np.argsort(-np.abs(cov) / np.sqrt(var), kind="stable")[:keep].tolist()


def p_prior(rows: DataFrame, vectors: DataFrame, key: str, residual: str, prefixes: list[int], rhos: list[float]) -> dict[str, tuple[float, list[int], float, np.ndarray]]:
    """Linear priors of a key's mean residual from its vector: for the first k components and for the k strongest, the best rho.

    Returns name: (weighted error, components, intercept, coefficients). ``vectors``: ``key, v``. One pass over the rows gives the keys' means, one over the keys all sums.
    """
    keys = rows.groupBy(key).agg(F.avg(residual).alias("_t"), F.count("*").alias("_n")).join(vectors, key)
    gram, product, weight = vector_gram(keys, ["v"], "_t", "_n")
    square = keys.agg(F.sum(F.col("_n") * F.col("_t") * F.col("_t"))).first()[0]
    out = {}
    for k in prefixes:
        for name, dims in ((f"first{k}", list(range(k))), (f"strongest{k}", strongest(gram, product, weight, k))):
            for rho in rhos:
                intercept, c = centred_ridge(gram, product, weight, dims, rho)
                full = np.zeros(len(gram))
                full[0], full[np.array(dims) + 1] = intercept, c
                error = (square - 2 * full @ product + full @ gram @ full) / weight
                if name not in out or error < out[name][0]:
                    out[name] = (float(error), dims, intercept, c)
    return out


def linear_head(rows: DataFrame, vectors: list[str], target: str, rho: float) -> np.ndarray:
    """Intercept and coefficients of all components of the vectors, one after the other."""
    gram, product, _ = vector_gram(rows, vectors, target)
    penalty = rho * np.eye(len(gram))
    penalty[0, 0] = 0
    return np.linalg.solve(gram + penalty, product)


def pair_head(rows: DataFrame, p: str, q: str, target: str, rank: int, rho: float, rounds: int = 4, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Low-rank product head: matrices A, B (components x rank) so that the sum over r of (p A_r)(q B_r) is near the target.

    With either matrix held, the other is a ridge fit of the vector's components times the held side's projections.
    """
    first = rows.select(F.size(p).alias("k"), F.size(q).alias("l")).first()
    rng = np.random.default_rng(seed)
    b = rng.normal(0, first["l"] ** -0.5, (first["l"], rank))
    a = np.zeros((first["k"], rank))
    for _ in range(rounds):
        for side in (0, 1):
            free, held, m = (p, q, b) if side == 0 else (q, p, a)

            def products(x: np.ndarray, y: np.ndarray, m=m) -> np.ndarray:
                """Component k times projection r stands at k * rank + r."""
                return (x.astype(float)[:, :, None] * (y.astype(float) @ m)[:, None, :]).reshape(len(x), -1)

            gram, product, _ = vector_gram(rows, [free, held], target, made=products)
            found = np.linalg.solve(gram[1:, 1:] + rho * np.eye(len(gram) - 1), product[1:]).reshape(-1, rank)
            if side == 0:
                a = found
            else:
                b = found
    return a, b


def _weighted(vector: str, coefficients: np.ndarray) -> Column:
    numbers = F.lit(np.asarray(coefficients, float))
    return F.aggregate(F.zip_with(F.col(vector), numbers, lambda x, c: x.cast("double") * c), F.lit(0.0), lambda t, x: t + x)


def pair_score(p: str, q: str, a: np.ndarray, b: np.ndarray) -> Column:
    out = F.lit(0.0)
    for r in range(a.shape[1]):
        out = out + _weighted(p, a[:, r]) * _weighted(q, b[:, r])
    return out


def mlp_head(rows: DataFrame, vectors: list[str], target: str, hidden: int, steps: int = 60, rate: float = 0.05, decay: float = 1e-4, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """(w, hidden, bias, out, intercept) of w x + sum of out_h relu(hidden_h x + bias_h), by full gradients.

    A step is one pass: each task sums the gradient of its rows, and the tasks' sums are added up.
    """
    held = stage(rows.select(*vectors, F.col(target).cast("double").alias("_y")))
    sizes = held.select(*[F.size(v).alias(v) for v in vectors]).first()
    n, k = held.count(), sum(sizes)
    rng = np.random.default_rng(seed)
    p = [np.zeros(k), rng.normal(0, k**-0.5, (hidden, k)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    ends = np.cumsum([v.size for v in p])
    m, v = np.zeros(ends[-1]), np.zeros(ends[-1])
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("value", T.DoubleType())])
    for step in range(1, steps + 1):

        def run(batches: Iterator[pa.RecordBatch], p=p) -> Iterator[pa.RecordBatch]:
            w, h, b, out, c = p
            total = np.zeros(ends[-1])
            for batch in batches:
                if batch.num_rows:
                    x = np.concatenate([batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for name in vectors], axis=1).astype(float)
                    z = x @ h.T + b
                    active = np.maximum(z, 0)
                    off = x @ w + active @ out + c[0] - batch.column("_y").to_numpy(zero_copy_only=False)
                    back = off[:, None] * out * (z > 0)
                    total += np.concatenate([x.T @ off, (back.T @ x).ravel(), back.sum(axis=0), active.T @ off, [off.sum()]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=schema.names)

        cells = held.mapInArrow(run, schema).groupBy("cell").agg(F.sum("value").alias("value")).collect()  # one number for each parameter
        g = np.zeros(ends[-1])
        for r in cells:
            g[r["cell"]] = r["value"] / n
        flat = np.concatenate([x.ravel() for x in p])
        g += decay * flat
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        flat = flat - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        p = [x.reshape(old.shape) for x, old in zip(np.split(flat, ends[:-1]), p, strict=True)]
    discard(held)
    return p[0], p[1], p[2], p[3], float(p[4][0])


def factor_tables(rows: DataFrame, key: str, residual: str, n_keys: int, n_high: int, n_low: int, rank: int, rounds: int = 8, reg: float = 1.0, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """``h, a`` and ``l, b``: the sum over r of a[floor(u H / U)] b[u mod L] fits the residuals, by alternating least squares.

    Rows are summed by (h, l) once; a cell table of at most H x L rows is solved for one side's entries at a time, each by itself.
    """
    at = F.floor(F.col(key) * n_high / F.lit(n_keys)).cast("long")
    cells = rows.groupBy(at.alias("h"), F.pmod(F.col(key), F.lit(n_low)).cast("long").alias("l")).agg(F.sum(residual).alias("s"), F.count("*").cast("double").alias("n"))
    cells = stage(cells)
    start = F.array(*[F.lit(1.0 if k == 0 else 0.0) + F.randn(seed + k) * 0.3 for k in range(rank)])
    tables = {"l": stage(cells.select("l").distinct().withColumn("x", start)), "h": None}

    def solve(data: pd.DataFrame) -> np.ndarray:
        x, n = np.stack(data["x"].to_list()), data["n"].to_numpy()
        return np.linalg.solve((x * n[:, None]).T @ x + reg * np.eye(rank), x.T @ data["s"].to_numpy())

    for _ in range(rounds):
        for own, other in (("h", "l"), ("l", "h")):

            def one(k: tuple, data: pd.DataFrame) -> pd.DataFrame:
                return pd.DataFrame({"k": [int(k[0])], "x": [solve(data).tolist()]})

            found = cells.join(tables[other], other).groupBy(own).applyInPandas(one, "k long, x array<double>")
            before, tables[own] = tables[own], stage(found.withColumnRenamed("k", own))
            if before is not None:
                discard(before)
    return tables["h"].withColumnRenamed("x", "a"), tables["l"].withColumnRenamed("x", "b")
