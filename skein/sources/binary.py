"""Binary rating files and NumPy arrays as Spark data sources, read in ranges of rows by many tasks.

``rating_binary``: magic ``SVDJUDGE``, then version 1, users, items, dimension, two row counts (int32), the mean (float32) and two
reserved int32; user and item factors (float32); two tables of (int32 user, int32 item, float32 rating). Option ``part``: ``stream`` or ``test``
(``pos, u, i, rating``), ``users`` or ``items`` (``id, vec``). ``npy``: a one- or two-dimensional array (``pos, vec``). Files must
be on a path that every executor can open.
"""

from __future__ import annotations

import ast
import struct

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC, HEADER = b"SVDJUDGE", struct.Struct("<8s6if2i")
ROWS_PER_TASK = 1 << 18


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def _ranges(n: int, rows: int) -> list[Range]:
    return [Range(a, min(a + rows, n)) for a in range(0, n, rows)] or [Range(0, 0)]


class _RatingReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.part, self.rows = options["path"], options.get("part", "stream"), int(options.get("rowsPerTask", ROWS_PER_TASK))
        with open(self.path, "rb") as f:
            magic, version, users, items, dim, stream, test, _, _, _ = HEADER.unpack(f.read(HEADER.size))
            size = f.seek(0, 2)
        if magic != MAGIC or version != 1:
            raise ValueError(f"{self.path} is no rating file")
        factors = (users + items) * dim * 4
        places = {"users": (0, users, dim * 4), "items": (users * dim * 4, items, dim * 4), "stream": (factors, stream, 12), "test": (factors + stream * 12, test, 12)}
        self.start, self.n, self.width = places[self.part]
        self.start += HEADER.size
        if size < HEADER.size + factors + (stream + test) * 12:
            raise ValueError(f"{self.path} is cut short")

    def partitions(self):
        return _ranges(self.n, self.rows)

    def read(self, partition):
        import numpy as np

        with open(self.path, "rb") as f:
            f.seek(self.start + partition.first * self.width)
            data = f.read((partition.last - partition.first) * self.width)
        if self.part in ("users", "items"):
            for k, row in enumerate(np.frombuffer(data, "<f4").reshape(-1, self.width // 4)):
                yield partition.first + k, [float(x) for x in row]
        else:
            for k, (u, i, r) in enumerate(struct.iter_unpack("<iif", data)):
                yield partition.first + k, u, i, float(r)


class RatingBinary(DataSource):
    @classmethod
    def name(cls):
        return "rating_binary"

    def schema(self):
        return "id long, vec array<float>" if self.options.get("part", "stream") in ("users", "items") else "pos long, u int, i int, rating float"

    def reader(self, schema):
        return _RatingReader(self.options)


class _NpyReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rows = options["path"], int(options.get("rowsPerTask", ROWS_PER_TASK))
        with open(self.path, "rb") as f:
            if f.read(6) != b"\x93NUMPY":
                raise ValueError(f"{self.path} is no NumPy array")
            size = struct.unpack("<H" if f.read(2)[0] == 1 else "<I", f.read(2))[0]
            head = ast.literal_eval(f.read(size).decode())
            self.start = f.tell()
        if head["fortran_order"] or len(head["shape"]) not in (1, 2):
            raise ValueError("only one- and two-dimensional arrays in row order")
        self.kind, self.n, self.columns = head["descr"], head["shape"][0], (*head["shape"], 1)[1]

    def partitions(self):
        return _ranges(self.n, self.rows)

    def read(self, partition):
        import numpy as np

        kind = np.dtype(self.kind)
        with open(self.path, "rb") as f:
            f.seek(self.start + partition.first * self.columns * kind.itemsize)
            data = f.read((partition.last - partition.first) * self.columns * kind.itemsize)
        for k, row in enumerate(np.frombuffer(data, kind).reshape(-1, self.columns)):
            yield partition.first + k, [float(x) for x in row]


class Npy(DataSource):
    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return "pos long, vec array<double>"

    def reader(self, schema):
        return _NpyReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RatingBinary)
    spark.dataSource.register(Npy)
