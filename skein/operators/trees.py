"""Gradient-boosted regression trees over histograms, grown leaf by leaf.

Features are cut into bins by their quantiles once, and the binned rows with what the trees so far leave are a table. A tree grows best leaf first within a budget of leaves. The histograms (rows and residual sums
for each leaf, feature and bin) of all leaves that may be split next come from one aggregation: each task routes its rows down the tree and adds up its own
histograms, so what is shuffled is bounded by leaves x features x bins a task. Splits below the leaves at hand are prepared ahead, so a tree takes about as many aggregations as it is deep, and
the order of splits is still best first.

Special cases: a null or NaN feature has a bin of its own, below all others; a feature of one value is never split; rows with a null target take no part; a table without rows gives a model without trees whose score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.stage import discard, stage


@dataclass
class Tree:
    """Node k splits at ``feature[k]``: bins up to ``cut[k]`` go to ``left[k]``, others to ``right[k]``; a leaf has feature -1 and a value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, at, at + 1
        for new in (self.feature, self.cut, self.left, self.right, self.value):
            new.extend([-1, -1] if new in (self.feature, self.left, self.right) else [0, 0])
        return at, at + 1

    def route(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of each row of bins (rows x features)."""
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.cut, self.left, self.right))
        node, todo = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(todo):
            todo = todo[feature[node[todo]] >= 0]
            at = node[todo]
            node[todo] = np.where(bins[todo, feature[at]] <= cut[at], left[at], right[at])
        return node


@dataclass
class Forest:
    """Trees over ``columns``; ``edges`` are each column's bounds between bins."""

    columns: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def bins(self, values: np.ndarray) -> np.ndarray:
        """Bins of rows of values (rows x features): 0 for none, else one more than there are bounds below."""
        out = np.zeros(values.shape, np.int16)
        for k, edges in enumerate(self.edges):
            known = ~np.isnan(values[:, k])
            out[known, k] = np.searchsorted(np.array(edges), values[known, k], "left") + 1
        return out

    def predict(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.base)
        for tree in self.trees:
            total += np.array(tree.value)[tree.route(bins)]
        return total

    def score(self) -> Column:
        """Prediction of a row, from its columns."""

        @F.pandas_udf("double")
        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series(self.predict(self.bins(np.column_stack([c.to_numpy(np.float64, na_value=np.nan) for c in columns]))))

        return run(*[F.col(c).cast("double") for c in self.columns])


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.int16).reshape(batch.num_rows, width)


def _binned(rows: DataFrame, forest: Forest, target: str) -> DataFrame:
    """``bins`` (packed) and ``left``: what the forest leaves of the target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = forest.bins(np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(forest.columns))]).astype(np.float64))
            left = batch.column("_y").to_numpy(zero_copy_only=False) - forest.predict(bins)
            yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bins], pa.binary()), pa.array(left)], names=["bins", "left"])

    return rows.select(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"_{k}") for k, c in enumerate(forest.columns)], F.col(target).cast("double").alias("_y")).mapInArrow(run, "bins binary, left double")


def _less(rows: DataFrame, tree: Tree, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = batch.column("left").to_numpy() - np.array(tree.value)[tree.route(_matrix(batch, width))]
            yield pa.RecordBatch.from_arrays([batch.column("bins"), pa.array(left)], names=["bins", "left"])

    return rows.mapInArrow(run, rows.schema)


def _histograms(rows: DataFrame, tree: Tree, leaves: list[int], width: int, bins: int) -> dict[int, np.ndarray]:
    """Of each of ``leaves``: rows and residual sums (2 x features x bins)."""
    place = np.full(len(tree.feature), -1)
    place[leaves] = np.arange(len(leaves))
    cells = len(leaves) * width * bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, cells))
        for batch in batches:
            x = _matrix(batch, width)
            at = place[tree.route(x)]
            some = at >= 0
            cell = ((at[some, None] * width + np.arange(width)) * bins + x[some]).ravel()
            total[0] += np.bincount(cell, minlength=cells)
            total[1] += np.bincount(cell, weights=np.repeat(batch.column("left").to_numpy()[some], width), minlength=cells)
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0, used]), pa.array(total[1, used])], names=["cell", "n", "s"])

    found = rows.mapInArrow(run, "cell long, n double, s double").groupBy("cell").agg(F.sum("n"), F.sum("s")).collect()  # leaves x features x bins at most
    out = np.zeros((2, cells))
    for cell, n, s in found:
        out[:, cell] = n, s
    return dict(zip(leaves, out.reshape(2, len(leaves), width, bins).swapaxes(0, 1), strict=True))


def best_split(histogram: np.ndarray, shrink: float, least_rows: int) -> tuple[float, int, int] | None:
    """Gain in squared error, feature and last bin to the left of the best split that leaves enough rows on both sides."""
    n, s = histogram.cumsum(axis=2)
    whole_n, whole_s = n[0, -1], s[0, -1]
    gain = s**2 / (n + shrink + 1e-300) + (whole_s - s) ** 2 / (whole_n - n + shrink + 1e-300) - whole_s**2 / (whole_n + shrink + 1e-300)
    gain[(n < least_rows) | (whole_n - n < least_rows)] = -np.inf
    k = int(gain.argmax())
    return (float(gain.flat[k]), *divmod(k, gain.shape[1])) if gain.flat[k] > 1e-12 else None


def grow(rows: DataFrame, width: int, bins: int, leaves: int, rate: float, shrink: float, least_rows: int) -> Tree:
    """A tree of at most ``leaves`` leaves, the best split first."""
    ahead, splits, stats = Tree(), {}, {}
    frontier = [0]
    while True:
        for node, h in _histograms(rows, ahead, frontier, width, bins).items():
            stats[node] = (h[0, 0].sum(), h[1, 0].sum())
            splits[node] = best_split(h, shrink, least_rows)
        chosen, open_ = [], [0]  # best first, as far as it is known what lies below
        while len(open_) < leaves:
            ready = [(splits[n][0], -n) for n in open_ if splits[n]]
            if not ready:
                break
            node = -max(ready)[1]
            if ahead.left[node] not in splits:
                break
            chosen.append(node)
            open_.remove(node)
            open_ += [ahead.left[node], ahead.right[node]]
        else:
            break
        frontier = []
        for node in open_:
            if splits[node] and ahead.feature[node] < 0:
                frontier += ahead.split(node, *splits[node][1:])
        if not frontier:
            break
    tree, where = Tree(), {0: 0}
    for node in chosen:
        a, b = tree.split(where[node], ahead.feature[node], ahead.cut[node])
        where[ahead.left[node]], where[ahead.right[node]] = a, b
    for node in open_:
        n, s = stats[node]
        tree.value[where[node]] = rate * s / (n + shrink) if n else 0.0
    return tree


def boost(rows: DataFrame, columns: list[str], target: str, trees: int = 20, leaves: int = 31, rate: float = 0.1, shrink: float = 1.0, least_rows: int = 20, bins: int = 64, start: Forest | None = None) -> Forest:
    """A forest of ``trees`` more trees than ``start``, whose bins it keeps; without it bins are cut at quantiles and the base is the mean."""
    rows = rows.where(F.col(target).isNotNull())
    if start is None:
        shares = [k / bins for k in range(1, bins)]
        known = [F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), shares, 10_000).alias(f"q{k}") for k, c in enumerate(columns)]
        first = rows.agg(F.avg(F.col(target).cast("double")).alias("base"), *known).first()
        if first["base"] is None:
            return Forest(tuple(columns), tuple(() for _ in columns))
        start = Forest(tuple(columns), tuple(tuple(sorted(set(first[f"q{k}"] or ()))) for k in range(len(columns))), first["base"])
    forest = Forest(start.columns, start.edges, start.base, list(start.trees))
    width, most = len(forest.columns), max(map(len, forest.edges), default=0) + 2
    now = stage(_binned(rows, forest, target))
    for _ in range(trees):
        tree = grow(now, width, most, leaves, rate, shrink, least_rows)
        forest.trees.append(tree)
        before, now = now, stage(_less(now, tree, width))
        discard(before)
    discard(now)
    return forest
