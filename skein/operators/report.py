"""Summaries of repeated benchmark runs ``(grp, run, value)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def percentiles(runs: DataFrame, qs: list[float]) -> DataFrame:
    """``grp`` and a column p50, p95, ... for each share, linearly interpolated."""
    return runs.groupBy("grp").agg(*[F.percentile("value", F.lit(q)).alias(f"p{round(q * 100)}") for q in qs])


def outliers(runs: DataFrame) -> DataFrame:
    """``runs`` with ``keep``: modified z-score at most 3.5; without deviation, within 1.5 interquartile ranges; without either, all."""
    mid = runs.groupBy("grp").agg(F.median("value").alias("med"), F.percentile("value", F.lit(0.25)).alias("q1"), F.percentile("value", F.lit(0.75)).alias("q3"))
    dev = runs.join(mid, "grp")
    mad = dev.groupBy("grp").agg(F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"))
    iqr = F.col("q3") - F.col("q1")
    by_iqr = (F.col("value") >= F.col("q1") - 1.5 * iqr) & (F.col("value") <= F.col("q3") + 1.5 * iqr)
    by_mad = F.abs(0.6745 * (F.col("value") - F.col("med")) / F.col("mad")) <= 3.5
    keep = F.when(F.col("mad") > 0, by_mad).when(iqr > 0, by_iqr).otherwise(True)
    return dev.join(mad, "grp").select(*runs.columns, keep.alias("keep"))


def summary(marked: DataFrame) -> DataFrame:
    """Raw and filtered count, mean, median and total of each group."""
    kept = F.when(F.col("keep"), F.col("value"))
    return marked.groupBy("grp").agg(
        F.count("*").alias("runs"), F.count(kept).alias("kept"), F.avg("value").alias("mean"), F.avg(kept).alias("kept_mean"),
        F.median("value").alias("median"), F.median(kept).alias("kept_median"), F.sum("value").alias("total"),
    )


def mean_std(runs: DataFrame) -> DataFrame:
    return runs.groupBy("grp").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))


def pareto(points: DataFrame, part: str | None = None) -> DataFrame:
    """Points (``time, error``) that no point at most as slow is at most as wrong as. ``part``: one front for each value of it."""
    best = points.groupBy(*([part] if part else []), "time").agg(F.min("error").alias("error"))
    window = (Window.partitionBy(part) if part else Window.partitionBy()).orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("_before", F.min("error").over(window)).where("_before is null or error < _before").drop("_before")


def against(rows: DataFrame, key: str, base: str, how: str = "ratio") -> DataFrame:
    """``key, value, change``: each value over, or less, the base row's."""
    reference = rows.where(F.col(key) == base).agg(F.first("value").alias("_base"))
    change = F.col("_base") / F.col("value") if how == "ratio" else F.col("value") - F.col("_base")
    return rows.crossJoin(F.broadcast(reference)).select(key, "value", change.alias("change"))  # one row


def last_json(logs: DataFrame, schema: str, column: str = "log") -> DataFrame:
    """The last line of each log that isn't blank, parsed."""
    lines = F.filter(F.split(column, "\n"), lambda x: F.trim(x) != "")
    return logs.select(*[c for c in logs.columns if c != column], F.from_json(F.element_at(lines, -1), schema).alias("r")).select("*", "r.*").drop("r")
