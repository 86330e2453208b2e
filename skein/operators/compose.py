"""Composed rating models: a model is a value built of others, fitted and scored as a graph.

Models are frozen values, so equal parts are one part: however often a composition names the bias model with certain
parameters, it is fitted once and scored once for a set of requests, and its table is shared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import calibrate, models, ratings
from skein.stage import stage


@dataclass(frozen=True)
class Bias:
    """Alternating shrunken biases of users and items."""

    shrink: float = 10.0
    rounds: int = 1


@dataclass(frozen=True)
class ItemMean:
    """The item's mean rating; the mean of all without one."""


@dataclass(frozen=True)
class Factors:
    """``weight`` times the factors (by alternating least squares) of what ``base`` leaves, on top of it."""

    base: Bias
    rank: int = 8
    rounds: int = 5
    reg: float = 0.1
    weight: float = 1.0
    seed: int = 1


@dataclass(frozen=True)
class Neighbours:
    """``base`` plus the residuals of the users most alike."""

    base: Bias
    k: int = 40
    shrink: float = 1.0
    absolute: bool = True


@dataclass(frozen=True)
class Blend:
    base: Model
    other: Model
    weight: float


@dataclass(frozen=True)
class Ensemble:
    parts: tuple[tuple[float, Model], ...]
    intercept: float = 0.0
    normalize: bool = False


@dataclass(frozen=True)
class Calibrated:
    """``model`` calibrated by the features of :mod:`skein.operators.calibrate`."""

    model: Model
    coefficients: tuple[tuple[str, float], ...]
    intercept: float = 0.0


@dataclass(frozen=True)
class Stack:
    """``parts`` with weights fitted by least squares, in two levels, to scores of rows that the parts weren't fitted to.

    ``groups`` are the stacks of the first level, each a choice of parts by number; the second level weighs their scores. ``calibration`` names features of
    :mod:`skein.operators.calibrate` whose coefficients are fitted to what the second level leaves.
    """

    parts: tuple[Model, ...]
    groups: tuple[tuple[int, ...], ...] = ()
    folds: int = 5
    ridge: float = 1e-3
    calibration: tuple[str, ...] = ()


Model = Bias | ItemMean | Factors | Neighbours | Blend | Ensemble | Calibrated | Stack


def fold_of(folds: int, u: str = "u", i: str = "i") -> Column:
    """Fold of a rating by its ids."""
    return F.expr(f"pmod(pmod({u}, 10007) * 31 + pmod({i}, 10007) * 17, {folds})").cast("int")


def fold_grams(rows: DataFrame, columns: list[Column], target: str = "rating") -> dict[int, np.ndarray]:
    """For each fold the sums of products of 1, the columns and the target with each other: all that least squares over any folds need."""
    z = [F.lit(1.0), *columns, F.col(target).cast("double")]
    rows = rows.select("fold", *[c.alias(f"_{k}") for k, c in enumerate(z)])
    pairs = [(a, b) for a in range(len(z)) for b in range(a, len(z))]
    sums = [F.sum(F.col(f"_{a}") * F.col(f"_{b}")).alias(f"s{a}_{b}") for a, b in pairs]
    out = {}
    for r in rows.groupBy("fold").agg(*sums).collect():  # a row a fold
        g = np.zeros((len(z), len(z)))
        for a, b in pairs:
            g[a, b] = g[b, a] = r[f"s{a}_{b}"]
        out[r["fold"]] = g
    return out


def solve_gram(gram: np.ndarray, columns: list[int], ridge: float) -> np.ndarray:
    """Coefficients of the intercept and the columns (numbered from 1) by least squares; ``ridge``, in rows, holds all but the intercept."""
    at = [0, *columns]
    penalty = ridge * np.diag([0.0, *np.ones(len(columns))])
    return np.linalg.lstsq(gram[np.ix_(at, at)] + penalty, gram[at, -1], rcond=None)[0]


def stack_weights(grams: dict[int, np.ndarray], groups: list[tuple[int, ...]], ridge: float) -> np.ndarray:
    """Intercept and a weight for each part, both levels multiplied out.

    The second level is fitted to first-level scores of each fold with first-level weights of the other folds; they are linear in the parts' scores, so the folds' sums of products give them without another pass.
    """
    k = next(iter(grams.values())).shape[0] - 2
    whole = sum(grams.values())

    def first(gram: np.ndarray) -> np.ndarray:
        """From 1, parts and target to 1, the groups' scores and target."""
        w = np.zeros((k + 2, len(groups) + 2))
        w[0, 0] = w[-1, -1] = 1
        for g, parts in enumerate(groups):
            columns = [p + 1 for p in parts]
            w[[0, *columns], g + 1] = solve_gram(gram, columns, ridge)
        return w

    if len(groups) == 1:
        return first(whole)[:-1, 1]
    level = [first(whole - g if len(grams) > 1 else whole) for g in grams.values()]
    second = sum(w.T @ g @ w for w, g in zip(level, grams.values(), strict=True))
    return first(whole)[:-1, :-1] @ solve_gram(second, list(range(1, len(groups) + 1)), ridge)


def make_model(name: str, bias: Bias = Bias(), rank: int = 8, weight: float = 0.3) -> Model:
    """A composition by name: ``baseline``, ``mf``, ``residual``, ``blend``, ``ensemble`` (blends and neighbours over one strong bias model, equal in kind) or ``stack`` (their parts, with fitted weights in two levels)."""
    strong = Bias(2.0, 20)
    known = {
        "baseline": bias,
        "mf": Factors(bias, rank),
        "residual": Factors(bias, rank, weight=weight),
        "blend": Blend(bias, Factors(bias, rank), weight),
        "ensemble": Ensemble(((0.4, Blend(strong, Factors(strong, 2 * rank), 0.45)), (0.4, Blend(strong, Factors(strong, rank, reg=0.3), 0.45)), (0.1, Neighbours(strong)), (0.1, strong)), normalize=True),
    }
    base, deep, near = Factors(strong, 2 * rank), Factors(strong, rank, reg=0.3), Neighbours(strong)
    known["stack"] = Stack((strong, Bias(10.0, 3), ItemMean(), base, deep, near), groups=((0, 1, 2), (0, 3, 4), (0, 3, 4, 5)))
    if name not in known:
        raise ValueError(f"unknown model {name}; known: {sorted(known)}")
    return known[name]


class Fitted:
    """Parts fitted to ``ratings`` (``u, i, rating``), each when it is first needed; ``fits`` counts them."""

    def __init__(self, ratings: DataFrame):
        self.ratings = ratings
        self.tables: dict[Model, tuple] = {}
        self.ends = models.limits(ratings)
        self.fits = 0

    def _bias(self, model: Bias) -> tuple:
        if model not in self.tables:
            self.tables[model] = models.bias_tables(self.ratings, model.shrink, model.rounds)
            self.fits += 1
        return self.tables[model]

    def out_of_fold(self, parts: tuple[Model, ...], folds: int) -> DataFrame:
        """``u, i, rating, fold, x0, x1, ...``: each rating with every part's score, fitted to the ratings of the other folds; equal parts are fitted once a fold."""
        rows = stage(self.ratings.select("u", "i", "rating", fold_of(folds).alias("fold")))
        out = None
        for fold in range(folds):
            base = here = rows.where(F.col("fold") == fold)
            fitted = Fitted(rows.where(F.col("fold") != fold).drop("fold"))
            asked, done = None, {}
            for k, part in enumerate(parts):
                if isinstance(part, Bias | ItemMean):
                    here = fitted._with_score(part, here).withColumnRenamed("score", f"x{k}")
                else:
                    asked = stage(base.select("u", "i").distinct()) if asked is None else asked
                    here = here.join(fitted._scored(part, asked, done).withColumnRenamed("score", f"x{k}"), ["u", "i"])
            self.fits += fitted.fits
            # Staged by fold: the folds' joins in one union get one task each.
            here = stage(here.select("u", "i", "rating", "fold", *[f"x{k}" for k in range(len(parts))]))
            out = here if out is None else out.unionByName(here)
        return out

    def _with_score(self, model: Bias | ItemMean, rows: DataFrame) -> DataFrame:
        """``rows`` with ``score`` by tables of users and items: no join on pairs."""
        if isinstance(model, Bias):
            return models.score_bias(rows, *self._bias(model))
        means = self.ratings.groupBy("i").agg(F.avg("rating").alias("m"))
        return rows.join(means, "i", "left").withColumn("score", F.coalesce("m", F.lit(self.ends[0]))).drop("m")

    def stacked(self, stack: Stack) -> Model:
        """The stack as a composition with fitted weights, and coefficients if it is calibrated."""
        if stack in self.tables:
            return self.tables[stack][0]
        n = len(stack.parts)
        groups = [*(stack.groups or (tuple(range(n)),))]
        rows = self.out_of_fold(stack.parts, stack.folds)
        grams = fold_grams(rows, [F.col(f"x{k}") for k in range(n)])
        if not grams:
            raise ValueError("no ratings to fit a stack to")
        w = stack_weights(grams, groups, stack.ridge)
        model: Model = Ensemble(tuple((float(v), p) for v, p in zip(w[1:], stack.parts, strict=True)), float(w[0]))
        if stack.calibration:
            # Features of a row come from the ratings of the other folds, as its parts' scores do; the score there is of weights from the other folds.
            names, own = ["pred", *stack.calibration], None
            whole = sum(grams.values())
            for fold, gram in grams.items():
                v = stack_weights({f: g for f, g in grams.items() if f != fold}, groups, stack.ridge) if len(grams) > 1 else w
                here = rows.where(F.col("fold") == fold)
                score = sum((float(x) * F.col(f"x{k}") for k, x in enumerate(v[1:])), F.lit(float(v[0])))
                rest = rows.where(F.col("fold") != fold).select("u", "i", "rating") if len(grams) > 1 else rows.select("u", "i", "rating")
                mean = float((whole - gram)[0, -1] / max((whole - gram)[0, 0], 1.0)) if len(grams) > 1 else self.ends[0]
                known = calibrate.features(mean)
                low, high = self.ends[1:]
                made = calibrate.joined_profiles(here.select("u", "i", "rating", "fold", F.greatest(F.lit(low), F.least(F.lit(high), score)).alias("score")), rest)
                made = stage(made.select("rating", "fold", *[known[c].alias(f"f{k}") for k, c in enumerate(names)]))
                own = made if own is None else own.unionByName(made)
            total = sum(fold_grams(own, [F.col(f"f{k}") for k in range(len(names))]).values())
            c = solve_gram(total, list(range(1, len(names) + 1)), stack.ridge)
            model = Calibrated(model, tuple((n_, float(x)) for n_, x in zip(names, c[1:], strict=True)), float(c[0]))
        self.tables[stack] = (model,)
        return model

    def scores(self, model: Model, requests: DataFrame) -> DataFrame:
        """``u, i, score`` of each distinct requested pair."""
        asked = stage(requests.select("u", "i").distinct())
        return self._scored(model, asked, {})

    def _scored(self, model: Model, asked: DataFrame, done: dict[Model, DataFrame]) -> DataFrame:
        if model in done:
            return done[model]
        again = lambda m: self._scored(m, asked, done)
        if isinstance(model, Bias | ItemMean):
            out = self._with_score(model, asked).select("u", "i", "score")
        elif isinstance(model, Factors):
            self.fits += 1
            out = models.als_scores(asked, self.ratings, model.rank, model.rounds, model.reg, model.weight, model.seed, self._bias(model.base))
        elif isinstance(model, Neighbours):
            self.fits += 1
            out = models.user_knn(asked, self.ratings, model.k, model.shrink, self._bias(model.base), model.absolute)
        elif isinstance(model, Blend):
            out = models.blend(again(model.base), again(model.other), model.weight, self.ends)
        elif isinstance(model, Ensemble):
            out = models.ensemble([(w, again(m)) for w, m in model.parts], self.ends, model.intercept, model.normalize)
        elif isinstance(model, Stack):
            out = again(self.stacked(model))
        else:
            out = calibrate.calibrate(again(model.model), self.ratings, dict(model.coefficients), model.intercept, self.ends)
        done[model] = stage(out)
        return done[model]


def predict_run(ratings_: DataFrame, requests: DataFrame, model: Model) -> DataFrame:
    """``u, i, score`` of the requests by a model fitted to all ratings; a pair that is requested several times is one row."""
    return Fitted(ratings_).scores(model, requests)


def eval_run(ratings_: DataFrame, model: Model, share: float = 0.25, seed: int = 0) -> DataFrame:
    """One row: rows fitted and held out, and the RMSE of a model that was fitted to the first, on the second."""
    held, fitted = (stage(r) for r in ratings.split(ratings_, share, seed))
    scored = Fitted(fitted).scores(model, held).join(ratings.disjoint(fitted, held), ["u", "i"])
    n = fitted.agg(F.count("*").alias("fitted"))
    return n.crossJoin(ratings.rmse(scored).withColumnRenamed("n", "held"))  # one row each


def eval_valid(metrics: DataFrame, base: str, score: str, least: float) -> DataFrame:
    """``metrics`` with ``valid``: both errors are finite, and the second is lower by at least ``least``."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in (base, score)]
    return metrics.withColumn("valid", F.coalesce(finite[0] & finite[1] & (F.col(base) - F.col(score) >= least), F.lit(False)))


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A model's tables under ``path``, one Parquet table each."""
    for name, table in tables.items():
        if not name.isidentifier():
            raise ValueError(f"{name!r} can't name a table")
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}

