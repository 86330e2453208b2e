"""Conversations from reply trees.

Messages point to the one they answer. Jump tables, each the self-join of the one before, give every
message's ancestor 1, 2, 4, ... steps up; joining the leaves with them doubles the known part of each
root-to-leaf path a round, so a thread of n messages takes log2(n) joins. Branches of a root are
ranked by the sum of their messages' scores (then length, then leaf), and each chosen path becomes
one conversation.

Paths are found and ranked on ids alone. Texts, known by a 128-bit hash of their message, join the chosen paths at the end and go
once more to the task that formats the path, in its order; no task holds more than one path.

The template marks a turn as ``### role``, its text and ``</turn>``, each on lines of their own. In roles and
texts ``\\``, ``#`` and ``<`` are preceded by ``\\``, and a role's newline is ``\\n``, so no text can pass for
a mark and unescaping gives it back. The loss mask is a list of (start, end) in code points: the escaped texts of the assistant.

Special cases: a null text or role is empty; a message whose parent is null or missing is a root; messages on or
below a cycle of replies have no root and no path; a path is formatted whole, however long; a
tree's messages with one id are one message, the least by (parent, role, hash of the text); messages without a tree or an id are left
out, but conversations' rows without an id are one conversation; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.llm.batches import slices
from skein.stage import discard, stage

_special = re.compile(r"[\\#<]")
_escaped = re.compile(r"\\(.)", re.DOTALL)
_turn = re.compile(r"### ((?:[^\\#<\n]|\\.)*)\n((?:[^\\#<]|\\.)*)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _special.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "\n</turn>\n"]
        at += len(head) + len(body) + 9
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    turns, at = [], 0
    while at < len(formatted):
        found = _turn.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2][:-1])))
        at = found.end()
    return turns


def reply_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """Chosen root-to-leaf paths: ``tree, root, leaf, rank, up, id``, a row for each message; ``up``: steps above the leaf.

    ``messages`` has ``tree, id, parent, score``, ids unique within a tree and no null in tree or id.
    """
    messages = messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    nodes = stage(messages.join(messages.groupBy("tree").agg(F.count("*").alias("size")), "tree"))
    ids = nodes.select("tree", "id", "size")
    jump = stage(nodes.select("tree", "id", "size", F.col("parent").alias("up_id")).join(ids.select("tree", F.col("id").alias("up_id")), ["tree", "up_id"]))
    parents = jump.select("tree", F.col("up_id").alias("id")).distinct()
    roots = stage(ids.join(jump.select("tree", "id"), ["tree", "id"], "left_anti").drop("size"))
    parts = [stage(ids.join(parents, ["tree", "id"], "left_anti").select("tree", F.col("id").alias("leaf"), "id", "size", F.lit(0).cast("long").alias("up")))]
    largest = nodes.agg(F.max("size")).first()[0] or 0
    for step in (1 << i for i in range(int(largest).bit_length())):
        # Trees of up to ``step`` messages have no path that long: their rows stay out of this round and the later ones.
        near, large = None, F.col("size") > step
        for part in parts:
            near = part.where(large) if near is None else near.unionByName(part.where(large))
        parts.append(stage(near.join(jump.drop("size"), ["tree", "id"]).select("tree", "leaf", F.col("up_id").alias("id"), "size", (F.col("up") + step).alias("up"))))
        second = jump.select("tree", F.col("id").alias("up_id"), F.col("up_id").alias("far"))
        before, jump = jump, stage(jump.where(F.col("size") > 2 * step).join(second, ["tree", "up_id"]).select("tree", "id", "size", F.col("far").alias("up_id")))
        discard(before)
        if jump.isEmpty():
            break
    paths = parts[0]
    for part in parts[1:]:
        paths = paths.unionByName(part)
    paths = paths.drop("size")
    branches = (
        paths.join(nodes.select("tree", "id", "score"), ["tree", "id"])
        .join(roots.withColumn("is_root", F.lit(True)), ["tree", "id"], "left")
        .groupBy("tree", "leaf")
        .agg(F.sum("score").alias("branch_score"), F.count("*").alias("length"), F.max(F.when(F.col("is_root"), F.col("id"))).alias("root"))
        .where("root is not null")
    )
    best = Window.partitionBy("tree", "root").orderBy(F.desc("branch_score"), F.desc("length"), "leaf")
    chosen = branches.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)
    return paths.join(chosen.select("tree", "leaf", "root", "rank"), ["tree", "leaf"]).select("tree", "root", "leaf", "rank", "up", "id")


def _hashes(*columns: Column | str) -> list[Column]:
    return [F.xxhash64(*columns).alias("l1"), F.xxhash64(F.lit(1), *columns).alias("l2")]


def _format(nodes: DataFrame, texts: DataFrame, keep: int) -> DataFrame:
    """``tree, root, leaf, rank, formatted, loss`` of the chosen paths. ``nodes``: messages by id without their texts; ``texts``: role and text by the hash (``l1, l2``) in ``nodes``."""
    nodes = stage(nodes)
    placed = reply_paths(nodes, keep).join(nodes.select("tree", "id", "l1", "l2"), ["tree", "id"]).drop("id")
    once = texts.groupBy("tree", "l1", "l2").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    path = ["tree", "root", "leaf", "rank"]
    turns = stage(placed).join(once, ["tree", "l1", "l2"]).select(*path, "up", "role", "text")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*turns.schema.fields[:4], T.StructField("formatted", T.StringType()), T.StructField("loss", T.ArrayType(span))])
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def emit(key: pa.RecordBatch, turns: list[tuple[str, str]]) -> pa.RecordBatch:
        formatted, loss = format_turns(turns)
        arrays = [*key.columns, pa.array([formatted], pa.string()), pa.array([[{"start": a, "end": b} for a, b in loss]], spans)]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, key = [], None, None
        for batch in slices(batches):
            keys = batch.select(path)
            for k, (at, role, text) in enumerate(zip(keys.to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                if at != now:
                    if held:
                        yield emit(key, held)
                    held, now, key = [], at, keys.slice(k, 1)
                held.append((role, text))
        if held:
            yield emit(key, held)

    return turns.repartition(*path[:3]).sortWithinPartitions(*path, F.desc("up")).drop("up").mapInArrow(run, schema)


def format_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """``tree, root, leaf, rank, formatted, loss`` for each chosen path of ``messages`` (``tree, id, parent, role, text, score``)."""
    rows = messages.select("tree", "id", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")
    rows = rows.where(F.col("tree").isNotNull() & F.col("id").isNotNull()).select("*", *_hashes("id", "role", "text"))
    first = F.min(F.struct("parent", "role", "l1", "l2", "score")).alias("m")
    nodes = rows.groupBy("tree", "id").agg(first).select("tree", "id", "m.parent", "m.score", "m.l1", "m.l2")
    return _format(nodes, rows.select("tree", "l1", "l2", "role", "text"), keep)


def read_back(formatted: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` with digests of the turns and of the text under the loss mask, read from ``formatted`` and ``loss`` alone."""
    out = [T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType())]
    out += [T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())]
    schema = T.StructType([formatted.schema[k] for k in keys] + out)

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for text, spans in zip(part.column("formatted").to_pylist(), part.column("loss").to_pylist(), strict=True):
                turns = parse_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(text)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *columns], names=schema.names)

    return formatted.select(*keys, "formatted", "loss").mapInArrow(run, schema)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Like :func:`format_paths` for rows of ``conv_id, turn, role, text``: each conversation is a tree in which a row answers the one before it (by turn, role, text).

    ``tree`` is a struct of ``none`` (no id) and ``conv_id`` (0 without one). Rows are put in order without their texts; only where several texts
    share conversation, turn and role do these take part.
    """
    tree = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("conv_id")).alias("tree")
    rows = conversations.select(tree, "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", *_hashes("turn", "role", "text"))
    place = ["tree", "turn", "role"]
    counted = stage(rows.groupBy(*place, "l1", "l2").agg(F.count("*").alias("n")))
    tied = counted.groupBy(*place).agg(F.count("*").alias("texts")).where("texts > 1").select("tree", F.struct(F.col("turn").isNull().alias("none"), "turn", "role").alias("at"))
    tied = stage(tied)
    if tied.isEmpty():  # else texts of the rows at these places join in; they alone are moved if Spark can broadcast the places
        told = counted.select("tree", "l1", "l2", F.lit(None).cast("string").alias("tie")).limit(0)
    else:
        told = rows.withColumn("at", F.struct(F.col("turn").isNull().alias("none"), "turn", "role")).join(tied, ["tree", "at"], "left_semi")
        told = told.groupBy("tree", "l1", "l2").agg(F.first("text").alias("tie"))
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", F.col("tie").asc_nulls_first(), "l1", "l2", "copy")
    each = counted.join(told, ["tree", "l1", "l2"], "left").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    nodes = each.select("tree", F.row_number().over(order).cast("long").alias("id"), "l1", "l2")
    nodes = nodes.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(1.0).alias("score"), "l1", "l2")
    return _format(nodes, rows.select("tree", "l1", "l2", "role", "text"), 1)
