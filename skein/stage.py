"""Cutting lineage with tables in the folder that the whole cluster shares.

A stage that is read more than once, or a loop that would otherwise grow its plan,
is written as Parquet under ``spark.checkpoint.dir`` and read back. The files
survive the loss of executors, which cached or locally checkpointed blocks don't.

What a block under :func:`owned` stages is dropped at its end; the rest when the process ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_staged: dict[str, tuple[SparkSession, str | None]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a temporary folder if all of Spark runs on this machine, else an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return f"file://{_own['dir']}"


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one that is dropped like a staged table."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _staged[path] = (spark, None)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    _staged[path] = (spark, None)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """Like :func:`stage`, but bucketed and sorted by ``keys``: joins on them read the table as it lies, and only the other side is shuffled."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"stage_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name.replace('_', '-')}"
    _staged[path] = (spark, name)
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return spark.table(name)


def stage_parted(df: DataFrame, key: str) -> DataFrame:
    """Like :func:`stage`, but with a folder for each value of ``key``, of which there are few: a filter on it reads that folder only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    _staged[path] = (spark, None)
    df.write.partitionBy(key).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(path: str) -> None:
    spark, name = _staged.pop(path)
    if name:
        spark.sql(f"drop table if exists {name}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files and catalogue entries of staged tables that nothing reads any more."""
    for table in tables:
        folders = {part for f in table.inputFiles() for part in f.split("/")[-3:-1]}  # a table's files lie in its folder, or in parts of it
        for path in [p for p in _staged if p.rsplit("/", 1)[1] in folders]:
            _drop(path)


@contextmanager
def owned() -> Iterator[None]:
    """Drops at its end what was staged inside; results must have been written or collected by then."""
    before = set(_staged)
    try:
        yield
    finally:
        for path in [p for p in _staged if p not in before]:
            _drop(path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, staged; what it staged on the way is dropped."""
    with owned():
        out = stage(make())
        kept = {p: _staged.pop(p) for p in [next(reversed(_staged))]}
    _staged.update(kept)
    return out


@atexit.register
def _drop_all() -> None:
    for path in list(_staged):
        if _staged[path][0].sparkContext._jsc is None:  # the session has ended; its own folder, if it had one, goes as a whole
            _staged.pop(path)
        else:
            _drop(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def literal_rows(spark: SparkSession, rows: list[tuple], schema: list[tuple[str, str]]) -> DataFrame:
    """A small table of whole numbers and strings as literals of the plan; no Python worker makes it."""

    def literal(value, kind: str) -> str:
        if value is None:
            return f"cast(null as {kind})"
        text = "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else str(value)
        return f"cast({text} as {kind})"

    values = ", ".join("(" + ", ".join(literal(v, k) for v, (_, k) in zip(row, schema, strict=True)) + ")" for row in rows)
    return spark.sql(f"select * from values {values} as t({', '.join(n for n, _ in schema)})")
