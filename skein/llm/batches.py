"""Arrow-batch helpers shared by the corpus operators.

Work that needs Python runs in ``mapInArrow`` over the rows of a partition; nothing is gathered.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes that Python holds unpacked at once, so that very long texts stay within a worker's memory; a longer row is alone.
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in turn, in slices of at most ``rows`` rows and, but for single rows, ``size`` bytes."""
    for batch in batches:
        todo = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > size:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def keep_rows(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[bool]]], column: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text passes; every column comes through untouched.

    ``make`` is called once in each task and returns the test for a list of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make()
        for part in slices(batches):
            yield part.filter(pa.array(test(texts_of(part, column)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def map_texts(
    docs: DataFrame,
    keys: list[str],
    out: list[tuple[str, T.DataType, pa.DataType]],
    make: Callable[[], Callable[[list[str]], list]],
    column: str = "text",
) -> DataFrame:
    """``keys`` of each row with new columns computed from its text.

    ``make`` is called once in each task and returns a function from texts to one list for each of ``out``.
    """
    own = [f.name for f in docs.schema if f.name in keys]
    schema = T.StructType([docs.schema[k] for k in own] + [T.StructField(n, t) for n, t, _ in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for part in slices(batches):
            made = compute(texts_of(part, column))
            arrays = [part.column(k) for k in own] + [pa.array(v, t) for v, (_, _, t) in zip(made, out, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=own + [n for n, _, _ in out])

    return docs.select(*dict.fromkeys([*own, column])).mapInArrow(run, schema)


def fold(column: str, parts: int):
    """Fold of a row: crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def fold_of(doc_id: int, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts
