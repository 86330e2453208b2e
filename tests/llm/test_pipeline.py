"""The pipeline on tables with nulls, without labels, items or documents, and with columns of clashing names."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class_id string, k1 int, score string"


def write(spark, path, documents, labels, benchmark):
    spark.createDataFrame(documents, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def row(k, text):
    return (k, text, None, "s", None, "x", 1, None)


def test_rows_that_come_through(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(f"item{k}" for k in range(12))
    texts = ["one two three four five six seven eight", "ONE two, three four five six seven eight!", None, "", "word " * 30_000, "x" * 100_000, f"before {item} after", "漢字 " * 50]
    documents = [row(k, t) for k, t in enumerate(texts)] + [row(0, texts[0]), row(3, "a text of its own for an id that is there twice"), row(None, "a text without an id"), row(None, None)]
    write(spark, tmp_path, documents, [], [(1, item), (None, None), (2, "")])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Without labels nothing is rejected; the copies of text 0 are one, and the row with the item goes.
    want = [(0, texts[0]), (2, ""), (3, ""), (4, texts[4]), (5, texts[5]), (7, texts[7]), (3, documents[9][1]), (None, documents[10][1]), (None, "")]
    assert sorted(map(str, ((r["doc_id"], r["decoded"]) for r in got))) == sorted(map(str, want))


@pytest.mark.parametrize("items", [[], [(1, "some item of some words")]])
def test_no_documents(spark, tmp_path, items):
    import corpus_pipeline

    write(spark, tmp_path, [], [], items)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
