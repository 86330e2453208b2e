"""Graphs, ratings and streams derived from the star-schema tables, as DataFrames and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators.graph import ranked
from skein.stage import read, stage

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"

EDGES = f"""edges as (select src, dst from (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by {_ORDER}) as dst
  from lineitem) t where dst is not null)"""
SPARSE = f"{EDGES}, sparse as (select src * 10 + 7 as src, dst * 10 + 7 as dst from edges)"
BIPARTITE = "edges as (select distinct l_suppkey as src, l_partkey + 100000 as dst from lineitem)"
FOREST = "edges as (select o_custkey as src, o_orderkey + 10000000 as dst from orders)"
NODES = "nodes as (select src as node from edges union select dst from edges)"
RATINGS = """ratings as (select o_custkey as u, l_partkey as i, avg(l_quantity) as rating
  from orders join lineitem on o_orderkey = l_orderkey group by o_custkey, l_partkey)"""
#: Deterministic split both engines compute alike.
HELD = "(u * 7919 + i * 104729) % 10 < 2"
SPLIT = f"{RATINGS}, fit as (select * from ratings where not ({HELD})), held as (select * from ratings where {HELD})"
STREAM = """stream as (select event_id as pos, user_id as u, event_id % 97 as i, "value" / 100.0 as rating from events)"""


def edges_part(spark: SparkSession, d: str) -> DataFrame:
    order = [c.strip() for c in _ORDER.split(",")]
    dst = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*order))
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), dst.alias("dst")).where("dst is not null")


def edges_sparse(spark: SparkSession, d: str) -> DataFrame:
    return edges_part(spark, d).select((F.col("src") * 10 + 7).alias("src"), (F.col("dst") * 10 + 7).alias("dst"))


def edges_bipartite(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 100000).alias("dst")).distinct()


def edges_forest(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 10000000).alias("dst"))


def ratings(spark: SparkSession, d: str, by: str | None = None) -> DataFrame:
    """``by`` (``u`` or ``i``) has all rows of an id come in one partition, in the same shuffle."""
    lines = read(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("i"), "l_quantity")
    orders = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("u"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("u", "i", "l_quantity")
    return (rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), by) if by else rows).groupBy("u", "i").agg(F.avg("l_quantity").alias("rating"))


def held(rows: DataFrame) -> DataFrame:
    return rows.where(HELD)


def fit(rows: DataFrame) -> DataFrame:
    return rows.where(f"not ({HELD})")


def stream(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(F.col("event_id").alias("pos"), F.col("user_id").alias("u"), (F.col("event_id") % 97).alias("i"), (F.col("value") / 100.0).alias("rating"))


def with_vectors(spark: SparkSession, d: str, rows: DataFrame, u: str, i: str) -> DataFrame:
    """``rows`` with ``pv`` and ``qv``: of all n vectors, in order of id, the one at ``u`` modulo n and the one at ``i`` modulo n."""
    v = stage(ranked(read(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "at"))
    n = v.count()
    p, q = (v.select(F.col("at").alias(f"_{c}"), F.col("embedding").alias(c)) for c in ("pv", "qv"))
    return rows.withColumn("_pv", F.expr(f"pmod({u}, {n})")).withColumn("_qv", F.expr(f"pmod({i}, {n})")).join(p, "_pv").join(q, "_qv").drop("_pv", "_qv")


def requests(spark: SparkSession, d: str) -> DataFrame:
    """``pos, u, i, pv, qv``: a request for each row of the stream; its user has the vector at u modulo their number, its item, of id ``pos``, that at pos."""
    return with_vectors(spark, d, stream(spark, d).select("pos", "u", F.col("pos").alias("i")), "u", "i")
