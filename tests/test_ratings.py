import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import fit, models, online, ratings, report
from skein.sources import binary, text
from skein.streaming import online as streaming


def frame(spark, rows):
    return spark.createDataFrame(rows, "u long, i long, rating double")


def test_bias_unknown_ids(spark):
    rows = frame(spark, [(1, 1, 4.0), (1, 2, 2.0), (2, 1, 5.0)])
    bias = models.bias_tables(rows, 1.0, 2)
    got = {(r["u"], r["i"]): r["score"] for r in models.score_bias(frame(spark, [(9, 9, 0.0), (1, 1, 0.0)]), *bias).collect()}
    assert abs(got[9, 9] - 11 / 3) < 1e-12 and 2 <= got[1, 1] <= 5


def test_rmse_and_disjoint(spark):
    rows = frame(spark, [(1, 1, 4.0)])
    assert ratings.rmse(rows.withColumn("score", F.lit(2.0))).first()["rmse"] == 2
    with pytest.raises(Exception, match="no rows"):
        ratings.rmse(rows.withColumn("score", F.lit(2.0)).where("u > 5")).collect()
    with pytest.raises(Exception, match="fit and evaluation"):
        ratings.disjoint(rows, rows).collect()
    with pytest.raises(ValueError):
        ratings.split(rows, 1.0)


def test_profile_without_variance(spark):
    got = ratings.profile(frame(spark, [(1, 1, 3.0), (1, 2, 3.0)]), "u").first()
    assert (got["variance"], got["skewness"], got["iqr"]) == (0, 0, 0)


def test_ensemble_weights(spark):
    rows = frame(spark, [(1, 1, 3.0)]).select("u", "i", F.col("rating").alias("score"))
    with pytest.raises(ValueError):
        models.ensemble([(1.0, rows), (-1.0, rows)], (3.0, 1.0, 5.0), normalize=True)
    assert models.ensemble([(1.0, rows), (3.0, rows)], (3.0, 1.0, 5.0), normalize=True).first()["score"] == 3
    with pytest.raises(ValueError):
        models.blend(rows, rows, 2.0, (3.0, 1.0, 5.0))


def test_online_contract(spark):
    p = online.Scoring(mean=3.0, intercept=None, item_stride=1, item_phase=0, user_stride=1, user_phase=0, scale_items=False, log_user=0, log_item=0, root_user=0, root_item=0, user_weight=1.15, item_weight=0.88, user_shrink=20.0, item_shrink=5.0)
    requests = spark.createDataFrame([(0, 0), (1, 1), (-1, 0)], "u long, i long")
    assert {r["score"] for r in online.score(requests, None, None, p).collect()} == {3.0}
    rows = spark.createDataFrame([(0, 0, 0, 5.0), (1, 1, 1, 1.0), (2, 0, 0, 5.0), (3, 2, 2, 4.0)], "pos long, u long, i long, rating double")
    got = {r["u"]: r["score"] for r in online.score(requests, *online.fit_states(rows, p), p, 3, 3).collect()}
    assert got[0] > 3 > got[1] and got[-1] == 3


def test_stream_equals_batch_in_several_batches(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("event_id"), F.current_timestamp().alias("ts"), (F.col("id") % 13).alias("user_id"), F.lit("x").alias("event_type"), (F.col("id") % 50 * 10.0).alias("value"))
    path = str(tmp_path / "events.parquet")
    rows.repartition(5).write.parquet(path)
    batch = online.state(streaming.rating_stream(spark, path).sparkSession.read.parquet(path).select(F.col("event_id").alias("pos"), F.col("user_id").alias("u"), (F.col("value") / 100).alias("rating")), "u", 2.5, 10, 0)
    want = sorted((r["u"], round(r["s"], 9), r["n"]) for r in batch.collect())
    for mode in ("update", "complete"):
        got = streaming.streamed_state(spark, path, "u", 2.5, 10, 0, mode=mode)
        assert sorted((r["u"], round(r["s"], 9), r["n"]) for r in got.collect()) == want


def test_late_rows_and_windows_that_expire(spark, tmp_path):
    """A row behind the watermark is left out; one that is late but not behind it counts."""
    path = tmp_path / "events.parquet"
    for k, minutes in enumerate(([0, 10, 70], [400], [395], [5, 350])):
        rows = [(m, f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00") for m in minutes]
        spark.createDataFrame(rows, "event_id long, ts string").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit("x").alias("event_type")).coalesce(1).write.mode("append").parquet(str(path))
    schema = spark.read.parquet(str(path)).schema
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path)).withWatermark("ts", "2 hours")
    counted = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.hour("w.start").alias("start"), "event_type", "n")
    got = {r["start"]: r["n"] for r in streaming.drain(counted, "update", ["start", "event_type"]).collect()}
    assert got == {0: 2, 1: 1, 6: 2, 5: 1}


def test_sources_and_sinks_by_file(spark, tmp_path):
    ranks = spark.createDataFrame([(2, 10, 0.25), (1, 7, 0.5)], "position int, node long, rank double")
    text.write_ranking(ranks, str(tmp_path / "rank"))
    back = text.ranking(spark, str(tmp_path / "rank")).orderBy(F.desc("rank")).collect()
    assert [(r["node"], r["rank"]) for r in back] == [(7, 0.5), (10, 0.25)]
    text.write_csv(ranks, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    scores = spark.createDataFrame([(1, 0, 5, 3.25), (1, 1, 6, 4.0), (2, 2, 5, 1.5)], "u long, pos long, i long, score double")
    text.write_predictions(scores, str(tmp_path / "pred"))
    lines = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "pred")).collect())
    assert "1|2" in lines and "2|1" in lines


def test_grouped_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1|2\n5  30\n6 40\n\n2|1\n5 10\n")
    assert sorted(map(tuple, text.grouped_ratings(spark, str(tmp_path / "a.txt")).collect())) == [(1, 5, 30.0), (1, 6, 40.0), (2, 5, 10.0)]
    (tmp_path / "b.txt").write_text("1|2\n5 30\n")
    with pytest.raises(Exception, match="ends after"):
        text.grouped_ratings(spark, str(tmp_path / "b.txt")).collect()


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of some 200 bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_grouped_files_over_many_blocks(spark, tmp_path, small_blocks):
    """Groups that span blocks, empty ones, blank lines between groups, no newline at the end, two files: as a reader of whole files has them."""
    rng = np.random.default_rng(3)
    want = []
    for name in "ab":
        out = []
        for u in range(60):
            n = int(rng.choice([0, 1, 3, 90]))
            group = [(int(i), float(r)) for i, r in zip(rng.integers(0, 10**6, n), rng.integers(0, 100, n), strict=True)]
            out += [f"{u}|{n}", *(f"{i}  {r}" for i, r in group), *[""] * int(rng.integers(0, 3))]
            want += [(u, k, i, r) for k, (i, r) in enumerate(group)]
        (tmp_path / name).write_text("\n".join(out))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    assert sorted(map(tuple, text.grouped_ratings(spark, str(tmp_path)).collect())) == sorted((u, i, r) for u, _, i, r in want)
    assert sorted(map(tuple, text.grouped_requests(spark, str(tmp_path)).collect())) == sorted((u, k, i) for u, k, i, _ in want)


@pytest.mark.parametrize(
    ("tail", "said"),
    [
        ("7|3\n1 2\n2 2", r"group 7 ends after 2 of 3 rows \(line 104"),
        ("7|3\n1 2\n8|0\n", r"group 7 ends after 1 of 3 rows \(line 104"),
        ("7|1\n1 2\n3 4\n", r"not a group's head: '3 4' \(line 104"),
        ("7|x\n", r"not a group's head: '7\|x' \(line 102"),
        ("7|2\n1 2\n3\n", r"group 7 ends after 1 of 2 rows: '3' \(line 104"),
        ("7|2\n1 2\n\n", r"group 7 ends after 1 of 2 rows \(line 104"),
    ],
)
def test_errors_of_grouped_files_name_the_line(spark, tmp_path, small_blocks, tail, said):
    (tmp_path / "a").write_text("1|100\n" + "5 6\n" * 100 + tail)
    with pytest.raises(Exception, match=said):
        text.grouped_ratings(spark, str(tmp_path)).collect()


def test_lines_that_are_no_edges(spark, tmp_path, small_blocks):
    lines = ["1 2"] * 300
    for k, bad in ((0, "x 1"), (150, "1 2 3"), (299, "-1 4"), (77, "")):
        lines[k] = bad
    (tmp_path / "e").write_text("\n".join(lines) + "\n")
    assert sorted((r["line"], r["value"]) for r in text.edge_errors(spark, str(tmp_path)).collect()) == [(1, "x 1"), (78, ""), (151, "1 2 3"), (300, "-1 4")]


def test_empty_grouped_files(spark, tmp_path):
    (tmp_path / "a").write_text("")
    (tmp_path / "b").write_text("\n\n")
    assert not text.grouped_ratings(spark, str(tmp_path)).collect()


def test_binary_sources(spark, tmp_path):
    binary.register(spark)
    p, q = np.arange(6, dtype="<f4").reshape(3, 2), np.ones((2, 2), "<f4")
    rows = b"".join(struct.pack("<iif", k % 3, k % 2, k / 2) for k in range(10))
    path = tmp_path / "r.bin"
    path.write_bytes(struct.pack("<8s6if2i", b"SVDJUDGE", 1, 3, 2, 2, 8, 2, 3.5, 0, 0) + p.tobytes() + q.tobytes() + rows)
    read = spark.read.format("rating_binary").option("path", str(path)).option("rowsPerTask", "3")
    assert [r["rating"] for r in read.load().orderBy("pos").collect()] == [k / 2 for k in range(8)]
    assert [list(r["vec"]) for r in read.option("part", "users").load().orderBy("id").collect()] == p.tolist()
    np.save(tmp_path / "x.npy", np.arange(8.0).reshape(4, 2))
    got = spark.read.format("npy").option("path", str(tmp_path / "x.npy")).option("rowsPerTask", "3").load().orderBy("pos").collect()
    assert [list(r["vec"]) for r in got] == np.arange(8.0).reshape(4, 2).tolist()


def test_segments_match_brute_force():
    from itertools import combinations

    rng = np.random.default_rng(1)
    points = [(float(x), float(rng.integers(1, 5)), float(rng.normal())) for x in range(9)]

    def error(cuts, values):
        return sum(w * (m - values[sum(c < x for c in cuts)]) ** 2 for x, w, m in points)

    best = np.inf
    for cuts in combinations(range(8), 2):
        groups = np.split(np.array(points), [c + 1 for c in cuts])
        best = min(best, error([float(c) for c in cuts], [(g[:, 1] * g[:, 2]).sum() / g[:, 1].sum() for g in groups]))
    assert abs(error(*fit.segments(points, 3)) - best) < 1e-9


def test_ridge_recovers(spark):
    rows = spark.range(200).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"), F.lit(1.0).alias("one"))
    got = fit.ridge(rows.withColumn("y", 2 * F.col("a") - F.col("b") + 3), ["one", "a", "b"], "y", 1e-9)
    assert np.allclose([got["one"], got["a"], got["b"]], [3, 2, -1], atol=1e-6)


def test_outliers_without_deviation(spark):
    runs = spark.createDataFrame([("a", k, v) for k, v in enumerate([1.0, 1.0, 1.0, 9.0])] + [("b", k, float(k)) for k in range(5)] + [("b", 9, 99.0)], "grp string, run int, value double")
    gone = {(r["grp"], r["value"]) for r in report.outliers(runs).where("not keep").collect()}
    assert ("b", 99.0) in gone and not any(g == "a" and v == 1.0 for g, v in gone)


def test_pareto(spark):
    points = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 4.0), (3, 4.5), (4, 4.0)], "time int, error double")
    assert sorted(map(tuple, report.pareto(points).collect())) == [(1, 5.0), (3, 4.0)]


def test_many_rounds_of_biases_move_no_rows(spark, monkeypatch):
    """Biases over packed cells, in many blocks, equal those by joins of rows; once laid out, ratings are in no shuffle of a round."""
    import numpy as np

    from skein.operators import cells

    rng = np.random.default_rng(8)
    pairs = [(int(u), int(i), float(r)) for u, i, r in zip(rng.integers(0, 90, 1500) + 5_000_000_000, np.minimum(rng.integers(0, 60, 1500), 40), rng.integers(1, 6, 1500))]
    rows = spark.createDataFrame([*pairs, (1, 2, None), (5_000_000_001, 3, None)], "u long, i long, rating double")
    args = (5.0, 7, 2.0, (0.9, 0.95), 3.1)
    monkeypatch.setattr(models, "PLAIN_ROUNDS", 100)
    want = [{r[0]: r[1] for r in t.collect()} for t in models.bias_tables(rows, *args)[:2]]
    monkeypatch.setattr(models, "PLAIN_ROUNDS", 4)
    monkeypatch.setattr(cells, "FEW", 12)
    made, make = [], cells.cells
    monkeypatch.setattr(cells, "cells", lambda *a: made.append(make(*a)) or made[-1])
    *tables, _ = models.bias_tables(rows, *args)
    got = [{r[0]: r[1] for r in t.collect()} for t in tables]
    assert len(made) == 2  # one layout for each direction, whatever the rounds
    for a, b in zip(got, want, strict=True):
        assert a.keys() == b.keys() and max(abs(a[k] - (b[k] or 0.0)) for k in a) < 1e-9


def test_pieces_hold_all_rows_once(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from skein.operators import cells

    monkeypatch.setattr(cells, "PIECE", 10)
    p, q = np.repeat([0, 0, 1, 2], 8).astype(np.int32), np.repeat([0, 1, 1, 0], 8).astype(np.int32)
    x, y = np.arange(32, dtype=np.int32), np.arange(32, dtype=np.int32)[::-1].copy()
    whole = pa.RecordBatch.from_arrays([pa.array(a) for a in (p, q, x, y)], ["p", "q", "x", "y"])
    pieces = [r for b in cells._pack(iter([whole.slice(0, 5), whole.slice(5, 0), whole.slice(5, 27)])) for r in b.to_pylist()]
    back = [(r["p"], r["q"], a, b) for r in pieces for a, b in zip(np.frombuffer(r["x"], np.int32), np.frombuffer(r["y"], np.int32), strict=True)]
    assert back == list(zip(p, q, x, y, strict=True)) and len(pieces) == 4
