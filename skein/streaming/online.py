"""The online state as Structured Streaming: a stateful aggregation of the sampled residuals, ending as the batch form does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from skein.operators.online import state
from skein.sources.batches import rating_batches
from skein.stage import scratch


def _pattern(path: str) -> str:
    """The path as a glob: a table may be one file, which the file source takes only from a glob."""
    return f"{path[:-1]}[{path[-1]}]"


def rating_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """``pos, u, i, rating`` from the event files as they arrive."""
    schema = spark.read.parquet(path).schema
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(_pattern(path))
    return e.select(F.col("event_id").alias("pos"), F.col("user_id").alias("u"), (F.col("event_id") % 97).alias("i"), (F.col("value") / 100.0).alias("rating"))


def batched_ratings(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """``pos, u, i, rating`` of the event table in fixed batches of ``rows`` rows."""
    e = rating_batches(spark, path, rows, ["event_id", "user_id", "value"])
    return e.select(F.col("event_id").alias("pos"), F.col("user_id").alias("u"), (F.col("event_id") % 97).alias("i"), (F.col("value") / 100.0).alias("rating"))


def run_out(writer: DataStreamWriter, fixed: bool) -> None:
    """Run a query until all that is there has been processed; sources of fixed batches know no bounded trigger and are stopped then."""
    if not fixed:
        writer.trigger(availableNow=True).start().awaitTermination()
        return
    query = writer.start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def _is_fixed(streaming: DataFrame) -> bool:
    return "rating_batches" in streaming._jdf.queryExecution().analyzed().toString()


def updates(streaming: DataFrame, mode: str = "update", path: str | None = None) -> DataFrame:
    """Every row that each batch of a streaming query over all that is there now gives out, with its ``batch``.

    Batches are tables in the shared folder, named by batch, so a batch that is repeated after a failure replaces itself. ``path`` is where they and the query's progress are kept to go on from; without it they are dropped like staged tables.
    """
    spark = streaming.sparkSession
    path = path or scratch(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    run_out(streaming.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/log").foreachBatch(keep), _is_fixed(streaming))
    schema = T.StructType([*streaming.schema.fields, T.StructField("batch", T.IntegerType())])
    try:
        return spark.read.schema(schema).parquet(f"{path}/rows")
    except AnalysisException:  # no batch
        return spark.createDataFrame([], schema)


def drain(streaming: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """Run a streaming query over all that is there now and return its result.

    ``complete``: the last batch's table. ``update``: the newest row of each key over all batches, of which each holds changed keys only.
    """
    rows = updates(streaming, mode)
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        return rows.where(F.col("batch") == (-1 if last is None else last)).drop("batch")
    values = [c for c in streaming.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch")).alias("v"))
    return newest.select(*keys, *[f"v.{c}" for c in values])


def streamed_state(spark: SparkSession, path: str, key: str, mean: float, stride: int, phase: int, scale: bool = False, mode: str = "update") -> DataFrame:
    """:func:`skein.operators.online.state` of the stream under ``path``."""
    return drain(state(rating_stream(spark, path), key, mean, stride, phase, scale), mode, [key])


def windowed_counts(spark: SparkSession, path: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start, event_type, n``: tumbling event-time windows with a watermark."""
    schema = spark.read.parquet(path).schema
    e = spark.readStream.schema(schema).parquet(_pattern(path)).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
    return drain(counted, "update", ["start", "event_type"])


def refit_per_batch(ratings: DataFrame, refit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``refit`` of the whole history after each batch of a stream of ratings: its rows with ``batch``, the number of the batch.

    Batches are kept as tables by their number, so a batch that is repeated after a failure is in the history once.
    """
    spark = ratings.sparkSession
    path = scratch(spark, "stream")
    last: list[int] = []

    def learn(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/history/batch={number}")
        history = spark.read.parquet(f"{path}/history").where(F.col("batch") <= number).drop("batch")
        refit(history).write.mode("overwrite").parquet(f"{path}/fitted/batch={number}")
        last.append(number)

    run_out(ratings.writeStream.option("checkpointLocation", f"{path}/log").foreachBatch(learn), _is_fixed(ratings))
    if not last:
        return refit(spark.createDataFrame([], ratings.schema)).withColumn("batch", F.lit(None).cast("int"))
    return spark.read.parquet(f"{path}/fitted")
