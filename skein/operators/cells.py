"""Sums along the edges of a bipartite table, for iterations that go over it many times.

Ids of both sides are numbered and dealt into blocks by their numbers; the rows between a block of one side and a block of the other lie packed, as pairs of
places of 32 bits, in pieces of at most ``PIECE`` rows. A round sends a block's values, packed too, to the pieces that have to do with it, and brings back one
sum for each place of the other side that a block's pieces have: what is shuffled are values of blocks, not rows. A block's values are all that a task holds
beside a piece, and an id with very many rows has them in several pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.graph import ranked
from skein.stage import discard, stage, stage_bucketed

#: Ids of a block at most; blocks that a side has at least, if they have ``FEW`` ids each; rows of a piece.
BLOCK, BLOCKS, FEW, PIECE = 1 << 20, 8, 1 << 16, 1 << 20


def numbered(ids: DataFrame, key: str, least: int = 1) -> tuple[DataFrame, int]:
    """``key, block, at`` of distinct ids, staged, and ids in a block; ``least`` blocks at least."""
    ids = stage(ids)
    n = ids.count()
    blocks = max(-(-n // BLOCK), min(BLOCKS, -(-n // FEW)), least)
    size = max(1, -(-n // blocks))
    at = F.col("_n")
    out = stage(ranked(ids, key, "_n").select(key, F.floor(at / size).cast("int").alias("block"), (at % size).cast("int").alias("at")))
    discard(ids)
    return out, size


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (``p, q, x, y``) that come by ``p`` and ``q`` in pieces."""
    cell, held, n = None, [], 0

    def piece() -> pa.RecordBatch:
        x, y = (np.concatenate(c).astype(np.int32) for c in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in cell] + [pa.array([v.tobytes()], pa.binary()) for v in (x, y)], ["p", "q", "x", "y"])

    for batch in batches:
        p, q, x, y = (batch.column(c).to_numpy() for c in "pqxy")
        starts = [0, *(np.flatnonzero((np.diff(p) != 0) | (np.diff(q) != 0)) + 1).tolist(), len(p)]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if a == b:
                continue
            if cell != (int(p[a]), int(q[a])) or n >= PIECE:
                if held:
                    yield piece()
                cell, held, n = (int(p[a]), int(q[a])), [], 0
            held.append((x[a:b], y[a:b]))
            n += b - a
    if held:
        yield piece()


@dataclass(frozen=True)
class Cells:
    """Pieces laid out by the block that sends (``p``): ``p, q, x, y``, places there and at the block that gets (``q``), of ``size`` ids."""

    pieces: DataFrame
    size: int

    def sums(self, values: DataFrame, run: str | None = None) -> DataFrame:
        """``block, places, sums`` (packed, 32 bits and double): for each place of the getting side the sum of the values (``block, v``, packed doubles) at its rows' other ends; several rows for a block.

        ``run`` names a whole-number column of ``values`` that tells several of them for a block apart; the sums have it too.
        """
        size = self.size
        values = values.withColumn("run", F.col(run) if run else F.lit(0))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, total, seen = None, None, None

            def out() -> pa.RecordBatch:
                at = np.flatnonzero(seen).astype(np.int32)
                return pa.RecordBatch.from_arrays([pa.array([cell[0]], pa.int32()), pa.array([cell[2]], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([total[at].tobytes()], pa.binary())], ["run", "block", "places", "sums"])

            for batch in batches:
                for r, p, q, x, y, v in zip(*(batch.column(c) for c in ("run", "p", "q", "x", "y", "v")), strict=True):
                    if cell != (r.as_py(), p.as_py(), q.as_py()):
                        if cell:
                            yield out()
                        cell, total, seen = (r.as_py(), p.as_py(), q.as_py()), np.zeros(size), np.zeros(size, bool)
                    x, y, v = np.frombuffer(x.as_buffer(), np.int32), np.frombuffer(y.as_buffer(), np.int32), np.frombuffer(v.as_buffer(), np.float64)
                    total += np.bincount(y, v[x], size)
                    seen[y] = True
            if cell:
                yield out()

        met = self.pieces.join(values.withColumnRenamed("block", "p"), "p").select("run", "p", "q", "x", "y", "v")
        made = met.sortWithinPartitions("run", "p", "q").mapInArrow(add, "run int, block int, places binary, sums binary")
        return made.withColumnRenamed("run", run) if run else made.drop("run")


def cells(rows: DataFrame, size: int) -> Cells:
    """``rows``: ``p, x, q, y``, block and place of the sending and of the getting side."""
    laid = rows.select("p", "q", "x", "y").repartition("p", "q").sortWithinPartitions("p", "q")
    return Cells(stage_bucketed(laid.mapInArrow(_pack, "p int, q int, x binary, y binary"), "p"), size)


def gathered(sums: list[np.ndarray], places: list[np.ndarray], size: int) -> np.ndarray:
    """One block's sums in one array."""
    out = np.zeros(size)
    for at, s in zip(places, sums, strict=True):
        out[np.frombuffer(at, np.int32)] += np.frombuffer(s, np.float64)
    return out


def unpacked(values: DataFrame) -> DataFrame:
    """``block, at, v`` of packed values."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, v in zip(*(batch.column(c) for c in ("block", "v")), strict=True):
                v = np.frombuffer(v.as_buffer(), np.float64)
                for first in range(0, len(v), 50_000):
                    cut = v[first : first + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), block.as_py(), np.int32)), pa.array(np.arange(first, first + len(cut), dtype=np.int32)), pa.array(cut)], ["block", "at", "v"])

    return values.mapInArrow(unpack, "block int, at int, v double")
