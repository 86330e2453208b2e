"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """``key, text, label`` of at most ``per_class`` documents of either class, and how many labelled ids each class has.

    The ids with the least hashes are taken. Of an id's several labels the greatest counts, of its several texts the one with the least hash; null labels
    don't count. The chosen ids are at most twice ``per_class``, so they are broadcast to the documents.
    """
    known = labels.where(usable & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("label"))
    counts = {int(r["label"]): r["count"] for r in known.where("label in (0, 1)").groupBy("label").count().collect()}
    chosen = None
    for value in (0, 1):
        some = known.where(F.col("label") == value).orderBy(F.xxhash64(key), key).limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    found = docs.select(key, F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(chosen), key)
    return found.groupBy(key, "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select(key, "text", "label"), counts
