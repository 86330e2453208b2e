"""Text files: edge lists, rankings, grouped ratings and requests, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LARGEST_ID = 2**31 - 1


def edges(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``src, dst`` of lines with two ids. Strict: any other line, a blank one included, is an error that quotes it; else blank lines are skipped."""
    return parse_edges(spark.read.text(path), strict)


def parse_edges(lines: DataFrame, strict: bool = True, column: str = "value") -> DataFrame:
    text = F.trim(column)
    good, pair = _is_edge(text)
    bad = F.raise_error(F.concat(F.lit("not an edge: '"), F.col(column), F.lit("'")))
    return (lines if strict else lines.where(text != "")).select(F.when(good, pair).otherwise(bad).alias("e")).select("e.src", "e.dst")


def _is_edge(text: Column) -> tuple[Column, Column]:
    """Whether a trimmed line is two ids, never null, and the ids."""
    parts = F.split(text, r"\s+")
    src, dst = (F.get(parts, F.lit(k)).try_cast("bigint") for k in (0, 1))
    good = (F.size(parts) == 2) & src.between(0, LARGEST_ID) & dst.between(0, LARGEST_ID)
    return F.coalesce(good, F.lit(False)), F.struct(src.alias("src"), dst.alias("dst"))


def ranking(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(parts[0].cast("long").alias("node"), parts[1].cast("double").alias("rank"))


def ranking_lines(top: DataFrame) -> DataFrame:
    return top.select("position", F.format_string("%d %.10f", "node", "rank").alias("value"))


def write_ranking(top: DataFrame, path: str) -> None:
    """One file, best first: ``top`` is a top-k list, so one task writes k lines."""
    ranking_lines(top).coalesce(1).sortWithinPartitions("position").select("value").write.text(path)


def numbered_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``file, block, at, value`` of the lines of text files, numbered from 1 in their block, and ``file, block, before`` of the blocks: lines of the file that stand before each.

    A file is read in blocks by many tasks; only their counts are put in order, one row for each block.
    """
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    read = spark.read.text(path).select("value", *meta)
    at = F.row_number().over(Window.partitionBy("file", "block").orderBy(F.monotonically_increasing_id()))
    before = F.sum("count").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    counts = read.groupBy("file", "block").count().select("file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    return read.select("file", "block", at.alias("at"), "value"), counts


def edge_errors(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value`` of the lines, numbered from 1, that aren't two ids: what :func:`edges` stops at."""
    lines, blocks = numbered_lines(spark, path)
    bad = lines.withColumn("good", _is_edge(F.trim("value"))[0]).where("not good")
    return bad.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("at")).alias("line"), "value")


def _grouped(spark: SparkSession, path: str, width: int) -> DataFrame:
    """``u, pos, i, rating`` of files in which ``id|count`` heads ``count`` lines.

    A file is read in blocks by many tasks. Lines before a block's first head belong to the last head of the blocks before, which is handed on from block to block, one
    row for each. Groups that end early, lines that aren't of the form and lines beyond their group's count are errors that name file and line; blank lines between groups are skipped.
    """
    lines, blocks = numbered_lines(spark, path)
    text = F.trim(F.col("value"), F.lit(" \t\r"))
    parts = F.split(text, r"\|")
    is_head = F.contains(text, F.lit("|"))
    head = F.when(is_head, F.struct("at", F.get(parts, F.lit(0)).try_cast("bigint").alias("u"), F.get(parts, F.lit(1)).try_cast("bigint").alias("n")))
    # The head before a line in its block, if there is one.
    own = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.select("file", "block", "at", text.alias("text"), head.alias("head")).withColumn("own", F.last("head", ignorenulls=True).over(own))
    # The last head of each block with its line in the file; what a block begins with; whether a file's last group is whole.
    ends = lines.select("file", "block", "at", head.alias("head")).groupBy("file", "block").agg(F.max("head").alias("head"), F.count("*").alias("count")).join(blocks, ["file", "block"])
    here = F.when(F.col("head").isNotNull(), F.struct((F.col("before") + F.col("head.at")).alias("line"), F.col("head.u").alias("u"), F.col("head.n").alias("n")))
    ordered = Window.partitionBy("file").orderBy("block")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.withColumn("here", here).select(
        "file", "block", "before", F.last("here", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
        F.last("here", ignorenulls=True).over(whole).alias("last"), F.sum("count").over(whole).alias("total"),
    )
    found = rows.join(ends, ["file", "block"]).withColumn("line", F.col("before") + F.col("at"))
    mine = F.struct((F.col("before") + F.col("own.at")).alias("line"), F.col("own.u").alias("u"), F.col("own.n").alias("n"))
    found = found.withColumn("of", F.when(F.col("own").isNotNull(), mine).otherwise(F.col("carried")))
    fields = F.split("text", r"\s+")
    item, rating = F.get(fields, F.lit(0)).try_cast("bigint"), F.get(fields, F.lit(1)).try_cast("double") if width > 1 else F.lit(None).cast("double")
    pos = F.col("line") - F.col("of.line") - 1
    inside = F.coalesce(pos < F.col("of.n"), F.lit(False))
    good = item.isNotNull() & (rating.isNotNull() if width > 1 else F.lit(True))

    def fail(said: str, *values) -> Column:
        return F.raise_error(F.format_string(said + " (line %d of %s)", *values, "line", "file"))

    short = fail("group %d ends after %d of %d rows", F.col("of.u"), pos, F.col("of.n"))
    cut = (F.col("line") == F.col("total")) & (F.col("last.line") + F.col("last.n") > F.col("total"))
    row = F.struct(F.col("of.u").alias("u"), pos.alias("pos"), item.alias("i"), rating.alias("rating"))
    none = F.lit(None).cast("struct<u:bigint,pos:bigint,i:bigint,rating:double>")
    checked = (
        F.when(cut, fail("group %d ends after %d of %d rows", F.col("last.u"), F.col("total") - F.col("last.line"), F.col("last.n")))
        .when(F.col("head").isNotNull() & (F.col("head.u").isNull() | F.col("head.n").isNull()), fail("not a group's head: '%s'", F.col("text")))
        .when(inside & (F.col("head").isNotNull() | (F.col("text") == "")), short)
        .when(inside & ~good, fail("group %d ends after %d of %d rows: '%s'", F.col("of.u"), pos, F.col("of.n"), F.col("text")))
        .when(inside, row)
        .when((F.col("text") == "") | F.col("head").isNotNull(), none)
        .otherwise(fail("not a group's head: '%s'", F.col("text")))
    )
    return found.select(checked.alias("row")).where("row is not null").select("row.*")


def grouped_ratings(spark: SparkSession, path: str) -> DataFrame:
    return _grouped(spark, path, 2).select("u", "i", "rating")


def grouped_requests(spark: SparkSession, path: str) -> DataFrame:
    return _grouped(spark, path, 1).select("u", "pos", "i")


def prediction_text(scored: DataFrame, whole: bool = True) -> DataFrame:
    """``u, value``: each user's head and rows in order of ``pos``; scores rounded half to even, or with six digits and no trailing zeros."""
    plain = F.regexp_replace(F.format_string("%.6f", "score"), r"\.?0+$", "")
    text = F.bround("score", 0).cast("long").cast("string") if whole else plain
    rows = scored.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("pos", F.concat_ws(" ", F.col("i").cast("string"), text).alias("line")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return rows.select("u", F.concat(F.col("u").cast("string"), F.lit("|"), F.size("l").cast("string"), F.lit("\n"), body).alias("value"))


def write_predictions(scored: DataFrame, path: str, whole: bool = True) -> None:
    prediction_text(scored, whole).repartitionByRange("u").sortWithinPartitions("u").select("value").write.text(path)


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True)
