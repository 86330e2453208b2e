"""Fixed batches of rows as a streaming source: ``rating_batches`` delivers a file's rows in order, so many a batch, the last batch shorter.

Options: ``path`` (a Parquet file or folder, or a rating file as in :mod:`skein.sources.binary`), ``rows`` (of a batch), ``rowsPerTask``, ``columns`` (of a Parquet table, separated by commas). An offset is a number of rows, so that
a batch that is repeated after a failure has the same rows, and a query that starts again goes on after its last one. A batch is read by many tasks, each its own
range as Arrow batches, in row order within the files sorted by name. Rows that are added to the files' end (or as files that sort after the others) come in later batches. Files are opened through Arrow's file systems (local, HDFS, S3, GCS).

Python sources have no bounded trigger, so a query runs with the usual trigger and is stopped when all there is has been processed (:func:`skein.streaming.online.drain`).
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader
from pyspark.sql.pandas.types import from_arrow_schema

from skein.operators.online import BATCH_ROWS
from skein.sources.binary import HEADER, MAGIC, ROWS_PER_TASK, Range


def _open(path: str):
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, where


class ParquetRows:
    """Rows of Parquet files by number."""

    def __init__(self, path: str, columns: list[str] | None):
        from pyarrow import fs, parquet

        system, where = _open(path)
        info = system.get_file_info(where)
        if info.type == fs.FileType.Directory:
            names = sorted(f.path for f in system.get_file_info(fs.FileSelector(where)) if f.path.endswith(".parquet"))
        else:
            names = [where]
        self.columns = columns
        self.system, self.groups, self.schema = system, [], None
        for name in names:
            with system.open_input_file(name) as f:
                file = parquet.ParquetFile(f)
                self.schema = self.schema or file.schema_arrow
                self.groups += [(name, g, file.metadata.row_group(g).num_rows) for g in range(file.metadata.num_row_groups)]
        self.ends = list(accumulate(n for _, _, n in self.groups))
        if self.schema is not None and columns:
            self.schema = pa.schema([self.schema.field(c) for c in columns])

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def read(self, first: int, last: int) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        k = bisect.bisect_right(self.ends, first)
        while k < len(self.groups) and first < last:
            name, group, n = self.groups[k]
            start = self.ends[k] - n
            with self.system.open_input_file(name) as f:
                at = start
                for batch in parquet.ParquetFile(f).iter_batches(row_groups=[group], columns=self.columns):
                    low, high = max(first, at), min(last, at + batch.num_rows)
                    if low < high:
                        yield batch.slice(low - at, high - low).select(self.schema.names)
                    at += batch.num_rows
                    if at >= last:
                        break
            k += 1
            first = max(first, self.ends[k - 1])


class StreamRows:
    """Stream rows of a rating file by number: ``pos, u, i, rating``."""

    schema = pa.schema([("pos", pa.int64()), ("u", pa.int32()), ("i", pa.int32()), ("rating", pa.float32())])

    def __init__(self, path: str):
        self.system, self.path = _open(path)
        with self.system.open_input_file(self.path) as f:
            magic, version, users, items, dim, self.n, _, _, _, _ = HEADER.unpack(f.read(HEADER.size))
            if magic != MAGIC or version != 1:
                raise ValueError(f"{path} is no rating file")
            self.start = HEADER.size + (users + items) * dim * 4
            if f.size() < self.start + self.n * 12:
                raise ValueError(f"{path} is cut short")

    def __len__(self) -> int:
        return self.n

    def read(self, first: int, last: int) -> Iterator[pa.RecordBatch]:
        import numpy as np

        with self.system.open_input_file(self.path) as f:
            for a in range(first, last, ROWS_PER_TASK):
                n = min(last - a, ROWS_PER_TASK)
                f.seek(self.start + 12 * a)
                rows = np.frombuffer(f.read(12 * n), np.dtype([("u", "<i4"), ("i", "<i4"), ("rating", "<f4")]))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), *(pa.array(np.ascontiguousarray(rows[c])) for c in ("u", "i", "rating"))], schema=self.schema)


def rows_of(options) -> ParquetRows | StreamRows:
    path = options["path"]
    system, where = _open(path)
    if system.get_file_info(where).is_file:
        with system.open_input_file(where) as f:
            if f.read(len(MAGIC)) == MAGIC:
                return StreamRows(path)
    columns = options.get("columns")
    return ParquetRows(path, [c.strip() for c in columns.split(",")] if columns else None)


class _BatchReader(DataSourceStreamReader):
    def __init__(self, options):
        self.options, self.at = options, 0
        self.rows, self.task = int(options.get("rows", BATCH_ROWS)), int(options.get("rowsPerTask", ROWS_PER_TASK))
        if self.rows < 1 or self.task < 1:
            raise ValueError("a batch and a task have a row at least")

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        """One batch further than the last that was planned, if there is more."""
        self.at = max(self.at, min(self.at + self.rows, len(rows_of(self.options))))
        return {"row": self.at}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.at = max(self.at, end["row"])  # a query that starts again names its last batch here
        return [Range(a, min(a + self.task, end["row"])) for a in range(start["row"], end["row"], self.task)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return rows_of(self.options).read(partition.first, partition.last)


class RatingBatches(DataSource):
    @classmethod
    def name(cls):
        return "rating_batches"

    def schema(self):
        return from_arrow_schema(rows_of(self.options).schema)

    def streamReader(self, schema):
        return _BatchReader(self.options)


def rating_batches(spark: SparkSession, path: str, rows: int = BATCH_ROWS, columns: list[str] | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The file's rows as a stream of batches of ``rows`` rows."""
    spark.dataSource.register(RatingBatches)
    stream = spark.readStream.format("rating_batches").option("path", path).option("rows", rows).option("rowsPerTask", rows_per_task)
    return (stream.option("columns", ",".join(columns)) if columns else stream).load()
