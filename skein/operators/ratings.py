"""Ratings ``(u, i, rating)``: counts, profiles, coverage, splits and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(ratings: DataFrame) -> DataFrame:
    """``side, id, n``: ratings of each user and item, from one pass."""
    g = ratings.groupingSets([["u"], ["i"]], "u", "i").agg(F.grouping("u").alias("no_user"), F.count("*").alias("n"))
    return g.select(F.when(F.col("no_user") == 0, "user").otherwise("item").alias("side"), F.coalesce("u", "i").alias("id"), "n")


def stats(ratings: DataFrame, requests: DataFrame) -> DataFrame:
    """One row of totals of the ratings and of the pairs to predict."""
    r = ratings.agg(
        F.countDistinct("u").alias("users"), F.countDistinct("i").alias("items"), F.count("*").alias("n"),
        F.min("rating").alias("low"), F.max("rating").alias("high"), F.avg("rating").alias("mean"),
    )
    r = r.withColumn("sparsity", 1 - F.col("n") / (F.col("users") * F.col("items")))
    q = requests.agg(F.countDistinct("u").alias("request_users"), F.count("*").alias("requests"))
    return r.crossJoin(q)  # one row each


def histogram(ratings: DataFrame) -> DataFrame:
    """``value, n``: ratings rounded half to even."""
    return ratings.groupBy(F.bround("rating", 0).cast("int").alias("value")).agg(F.count("*").alias("n"))


def coverage(ratings: DataFrame, requests: DataFrame) -> DataFrame:
    """One row: how many requested users, items and pairs the ratings know, and how thinly."""
    users = ratings.groupBy("u").agg(F.count("*").alias("nu"))
    items = ratings.groupBy("i").agg(F.count("*").alias("ni"))
    seen = requests.join(users, "u", "left").join(items, "i", "left")
    return seen.agg(
        F.count("*").alias("pairs"),
        F.count_if(F.col("nu").isNull()).alias("new_user_pairs"),
        F.count_if(F.col("ni").isNull()).alias("new_item_pairs"),
        F.count_if(F.col("nu").isNotNull() & F.col("ni").isNotNull()).alias("known_pairs"),
        F.min("nu").alias("least_user"), F.max("nu").alias("most_user"), F.min("ni").alias("least_item"), F.max("ni").alias("most_item"),
        *[F.count_if(F.col("nu") <= k).alias(f"user_le_{k}") for k in (20, 50, 100)],
        *[F.count_if(F.col("ni") <= k).alias(f"item_le_{k}") for k in (1, 5)],
    )


def split(ratings: DataFrame, share: float, seed: int = 0, parts: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Validation and training rows by an arithmetic hash of the pair, the same however rows are partitioned."""
    if not 0 < share < 1:
        raise ValueError("share lies outside 0..1")
    at = F.pmod(F.col("u") * 7919 + F.col("i") * 104729 + seed * 611953, F.lit(parts))
    return ratings.where(at < share * parts), ratings.where(at >= share * parts)


def rmse(scored: DataFrame, score: str = "score") -> DataFrame:
    """One row; no rows are an error."""
    n = F.count("*")
    return scored.agg(F.when(n == 0, F.raise_error(F.lit("no rows to evaluate")).cast("double")).otherwise(F.sqrt(F.avg(F.pow(F.col(score) - F.col("rating"), 2)))).alias("rmse"), n.alias("n"))


def disjoint(fit: DataFrame, evaluated: DataFrame) -> DataFrame:
    """``evaluated``, or an error at the first pair that was also fitted."""
    seen = fit.select("u", "i").distinct().withColumn("_fitted", F.lit(True))
    both = evaluated.join(seen, ["u", "i"], "left")
    return both.where(F.when(F.col("_fitted"), F.raise_error(F.lit("a pair is in fit and evaluation rows")).cast("boolean")).otherwise(True)).drop("_fitted")


def profile(ratings: DataFrame, key: str) -> DataFrame:
    """Per ``u`` or ``i``: n, mean, variance, median, iqr, min, max, skewness (population; 0 without variance)."""
    a = ratings.groupBy(key).agg(
        F.count("*").alias("n"), F.avg("rating").alias("mean"), F.var_pop("rating").alias("variance"),
        F.percentile("rating", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        F.min("rating").alias("low"), F.max("rating").alias("high"),
        F.avg(F.pow("rating", F.lit(3))).alias("m3"), F.avg(F.pow("rating", F.lit(2))).alias("m2"),
    )
    third = F.col("m3") - 3 * F.col("mean") * F.col("m2") + 2 * F.pow("mean", F.lit(3))
    skew = F.when(F.col("variance") > 1e-12, third / (F.pow(F.sqrt("variance"), F.lit(3)) + 1e-9)).otherwise(0.0)
    return a.select(key, "n", "mean", "variance", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "low", "high", skew.alias("skewness"))
