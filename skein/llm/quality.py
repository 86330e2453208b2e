"""Quality scores from gradient-boosted trees over document statistics.

Statistics of a whole text (lengths, character classes, repetition of words, lines and word pairs) are binned by
quantiles; trees of fixed depth are grown on gradient histograms and flattened into arrays
(feature, threshold, leaf), which numpy walks for all rows and trees of a batch together.
The trees are fitted on the driver to a bounded sample: at most ``PER_CLASS`` labelled documents of each class.
Scoring reads every document once, with no shuffle.

Special cases: a null or empty text has the statistics of an empty one and is scored like any other; texts
of any length are used whole; repeated rows get equal scores; without labelled rows of both
classes every score is the share of label 1 (0.5 if there are none); an empty table gives an
empty one; other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.batches import fold, keep_rows, map_texts
from skein.llm.labelled import labelled_sample

PER_CLASS = 6000
THRESHOLD = 0.5
TREES, DEPTH, BINS, RATE, L2, LEAST_ROWS = 80, 4, 64, 0.2, 1.0, 5.0

UPPER, LOWER, DIGIT, SPACE, STOP, MARK, OTHER = range(7)


def _classes() -> np.ndarray:
    """Class of each code point below 0x250; above: OTHER."""
    out = np.full(0x250, MARK, np.uint8)
    for i in range(0x250):
        c = chr(i)
        out[i] = UPPER if c.isupper() else LOWER if c.isalpha() else DIGIT if c.isdigit() else SPACE if c.isspace() else STOP if c in ".,;:?'\"-()" else MARK
    return np.append(out, OTHER)


_CLASS = _classes()
NAMES = "chars words word_mean word_sd distinct top_word repeats pair_distinct lines line_mean line_distinct upper lower digit space stop mark other char_entropy long_words capitals".split()


def statistics(text: str) -> list[float]:
    """The document statistics in the order of ``NAMES``."""
    words, lines = text.split(), text.split("\n")
    n, w = max(len(text), 1), max(len(words), 1)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = np.bincount(_CLASS[np.minimum(codes, 0x250)], minlength=7) / n
    counts = np.bincount(np.minimum(codes, 0x250))
    shares = counts[counts > 0] / n
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    tally: dict[str, int] = {}
    for word in words:
        tally[word] = tally.get(word, 0) + 1
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        sizes.mean(),
        sizes.std(),
        len(tally) / w,
        max(tally.values(), default=0) / w,
        sum(map(eq, words, words[1:])) / w,
        len(set(pairwise(words))) / w,
        np.log1p(len(lines)),
        np.log1p(n / len(lines)),
        len(set(lines)) / len(lines),
        *classes,
        -(shares * np.log(shares)).sum() if len(shares) else 0.0,
        (sizes > 12).mean(),
        sum(map(str.isupper, words)) / w,
    ]


@dataclass
class Trees:
    """Flattened trees of one depth: at node i of a tree the kids are 2i+1 and 2i+2; ``leaf`` is indexed from the first leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.leaf) and len(x):
            tree = np.arange(len(self.leaf))
            at = np.zeros((len(x), len(tree)), np.int64)
            rows = np.arange(len(x))[:, None]
            while at[0, 0] < self.feature.shape[1]:
                at = 2 * at + 1 + (x[rows, self.feature[tree, at]] > self.threshold[tree, at])
            total += self.leaf[tree, at - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Logistic boosting on histograms. Features are binned at quantiles, so a split costs one pass over the bins."""
    share = float((weight * y).sum() / weight.sum()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Trees(float(np.log(share / (1 - share))), np.zeros((0, 2**DEPTH - 1), int), np.zeros((0, 2**DEPTH - 1)), np.zeros((0, 2**DEPTH)))
    n, m = x.shape
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T  # m x BINS - 1
    bins = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1)
    slot = bins + np.arange(m) * BINS
    base = float(np.log(share / (1 - share)))
    total = np.full(n, base)
    inner = 2**DEPTH - 1
    feature, threshold, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (p - y), weight * p * (1 - p)
        at = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            where = ((at - first)[:, None] * (m * BINS) + slot).ravel()
            hist = [np.bincount(where, np.repeat(v, m), width * m * BINS).reshape(width, m, BINS).cumsum(axis=2) for v in (g, h, weight)]
            gl, hl, nl = (v[:, :, :-1] for v in hist)
            gt, ht, nt = (v[:, :, -1:] for v in hist)
            gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
            gain[(nl < LEAST_ROWS) | (nt - nl < LEAST_ROWS)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            j, b = np.divmod(best, BINS - 1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            feature[t, first : first + width] = np.where(good, j, 0)
            threshold[t, first : first + width] = np.where(good, edges[j, b], np.inf)
            own = at - first
            at = 2 * at + 1 + (good[own] & (bins[np.arange(n), j[own]] > b[own]))
        own = at - inner
        leaf[t] = -RATE * np.bincount(own, g, inner + 1) / (np.bincount(own, h, inner + 1) + L2)
        total += leaf[t][own]
    return Trees(base, feature, threshold, leaf)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, held_out: tuple[int, int] | None = (3, 1)) -> Trees:
    """Trees fitted to ``labels.quality``, of rows outside the held-out fold (parts, remainder)."""
    usable = fold("doc_id", held_out[0]) != held_out[1] if held_out else F.lit(True)
    sample, counts = labelled_sample(docs, labels, "quality", usable, per_class)
    floats = ("stats", T.ArrayType(T.DoubleType()), pa.list_(pa.float64()))
    found = map_texts(sample, ["doc_id", "label"], [floats], lambda: lambda texts: [[statistics(t) for t in texts]])
    rows = sorted(found.collect(), key=lambda r: r["doc_id"])  # at most 2 * per_class rows of numbers
    y = np.array([r["label"] for r in rows], float)
    kept = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.array([counts.get(int(c), 0) / kept[int(c)] for c in y])  # as common as among all labels
    return fit_trees(np.array([r["stats"] for r in rows]).reshape(-1, len(NAMES)), y, weight / max(weight.mean(), 1e-9) if len(y) else weight)


def _scorer(trees: Trees):
    def run(texts: list[str]) -> np.ndarray:
        return trees.score(np.array([statistics(t) for t in texts]).reshape(-1, len(NAMES)))

    return run


def score_documents(docs: DataFrame, trees: Trees, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, ``score`` (0 to 1, higher: label 1 likelier) of each row."""

    def make():
        score = _scorer(trees)
        return lambda texts: [score(texts)]

    return map_texts(docs, list(keys), [("score", T.DoubleType(), pa.float64())], make)


def keep_good(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows scored at ``threshold`` or more, with all their columns."""

    def make():
        score = _scorer(trees)
        return lambda texts: score(texts) >= threshold

    return keep_rows(docs, make)
