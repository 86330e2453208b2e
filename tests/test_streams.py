"""The source of fixed batches: exact batches, replay after a failure, restarts, and states that end as the batch forms do."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skein.operators import online
from skein.sources.batches import RatingBatches, ParquetRows, rating_batches
from skein.sources.binary import HEADER, MAGIC
from skein.streaming import online as streaming


def write_rating_file(path, n, users=3, items=4, dim=2):
    rng = np.random.default_rng(n)
    rows = np.zeros(n, np.dtype([("u", "<i4"), ("i", "<i4"), ("r", "<f4")]))
    rows["u"], rows["i"], rows["r"] = rng.integers(0, users, n), rng.integers(0, items, n), rng.integers(1, 11, n) / 2
    with open(path, "wb") as f:
        f.write(HEADER.pack(MAGIC, 1, users, items, dim, n, 0, 2.5, 0, 0) + bytes(4 * dim * (users + items)) + rows.tobytes())
    return [(k, *map(float, r)) for k, r in enumerate(rows.tolist())]


def write_tables(folder, sizes):
    at = 0
    for k, n in enumerate(sizes):
        pq.write_table(pa.table({"event_id": np.arange(at, at + n), "user_id": np.arange(at, at + n) % 7, "value": (np.arange(at, at + n) % 500).astype(float), "other": ["x"] * n}), folder / f"part-{k}.parquet", row_group_size=13)
        at += n
    return at


def batches_of(stream, path=None):
    rows = streaming.updates(stream, "append", path)
    return {r["batch"]: (r["n"], r["rows"]) for r in rows.groupBy("batch").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c != "batch"]))).alias("rows")).collect()}


def test_batches_of_a_rating_file_have_a_ragged_tail(spark, tmp_path):
    rows = write_rating_file(tmp_path / "r.bin", 1050)
    got = batches_of(rating_batches(spark, str(tmp_path / "r.bin"), 400, rows_per_task=90))
    assert {b: n for b, (n, _) in got.items()} == {0: 400, 1: 400, 2: 250}
    assert [tuple(map(float, r)) for b in sorted(got) for r in got[b][1]] == rows


def test_batches_of_parquet_files_in_order(spark, tmp_path):
    n = write_tables(tmp_path, [40, 0, 25, 60])
    got = batches_of(streaming.batched_ratings(spark, str(tmp_path), 50))
    assert [got[b][0] for b in sorted(got)] == [50, 50, 25]
    assert [r["pos"] for b in sorted(got) for r in got[b][1]] == list(range(n))
    rows = ParquetRows(str(tmp_path), ["event_id"])
    for a, b in ((0, 125), (12, 14), (39, 66), (124, 125), (60, 60)):
        assert [x for part in rows.read(a, b) for x in part.column(0).to_pylist()] == list(range(a, b))


def test_batch_is_repeated_after_a_failure_and_rows_that_come_later_follow(spark, tmp_path):
    table, log = tmp_path / "in", str(tmp_path / "log")
    table.mkdir()
    write_tables(table, [90])
    seen, failed = {}, []

    def keep(batch, number):
        ids = sorted(r[0] for r in batch.select("event_id").collect())
        if number == 1 and not failed:
            failed.append(ids)
            raise RuntimeError("lost")
        seen.setdefault(number, []).append(ids)

    def run():
        streaming.run_out(rating_batches(spark, str(table), 40, ["event_id"]).writeStream.option("checkpointLocation", log).foreachBatch(keep), True)

    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert failed == [list(range(40, 80))] and seen == {0: [list(range(40))], 1: [list(range(40, 80))], 2: [list(range(80, 90))]}
    pq.write_table(pa.table({"event_id": np.arange(90, 145), "user_id": np.zeros(55, int), "value": np.zeros(55), "other": ["y"] * 55}), table / "part-9.parquet")
    run()
    assert {k: v[0] for k, v in seen.items() if k > 2} == {3: list(range(90, 130)), 4: list(range(130, 145))}
    run()  # nothing is left
    assert len(seen) == 5


def test_states_over_batches_and_a_restart(spark, tmp_path):
    table = tmp_path / "in"
    table.mkdir()
    n = write_tables(table, [70, 80])
    rows = spark.read.parquet(str(table)).select(F.col("event_id").alias("pos"), F.col("user_id").alias("u"), (F.col("event_id") % 97).alias("i"), (F.col("value") / 100.0).alias("rating"))
    make = lambda: online.state(streaming.batched_ratings(spark, str(table), 40), "u", 2.5, 4, 2, True)
    kept = str(tmp_path / "kept")
    first = streaming.updates(make(), path=kept).collect()
    assert max(r["batch"] for r in first) == 3
    touched = {(b, p % 7) for p in range(n) if p % 4 == 2 for b in [p // 40]}
    assert {(r["batch"], r["u"]) for r in first} == touched
    pq.write_table(pa.table({"event_id": np.arange(150, 233), "user_id": np.arange(150, 233) % 7, "value": np.full(83, 99.0), "other": ["y"] * 83}), table / "part-9.parquet")
    after = streaming.updates(make(), path=kept)
    last = {r["u"]: (r["batch"], round(r["s"], 9), r["n"]) for r in sorted(after.collect(), key=lambda r: r["batch"])}
    rows = spark.read.parquet(str(table)).select(F.col("event_id").alias("pos"), F.col("user_id").alias("u"), (F.col("value") / 100.0).alias("rating"))
    assert {u: v[1:] for u, v in last.items()} == {r["u"]: (round(r["s"], 9), r["n"]) for r in online.state(rows, "u", 2.5, 4, 2, True).collect()}


def test_empty_and_broken_inputs(spark, tmp_path):
    write_rating_file(tmp_path / "none.bin", 0)
    assert streaming.updates(rating_batches(spark, str(tmp_path / "none.bin"), 10), "append").collect() == []
    (tmp_path / "cut.bin").write_bytes(HEADER.pack(MAGIC, 1, 1, 1, 1, 50, 0, 2.5, 0, 0) + b"12345678")
    with pytest.raises(ValueError, match="cut short"):
        RatingBatches({"path": str(tmp_path / "cut.bin")}).schema()
    with pytest.raises(ValueError, match="row at least"):
        RatingBatches({"path": str(tmp_path / "none.bin"), "rows": "0"}).streamReader(None)
