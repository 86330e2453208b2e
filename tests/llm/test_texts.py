"""Operators on texts: exact round trips, brute force, held-out accuracy, and the special cases of each."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skein.llm import chat, lengths, pieces, quality, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  two  spaces ", "a", "▁mark▁", "tab\tand\nline\n\n", "<s>x</s>", "ﬁ ünï 漢字 🙂🙂", "x" * 3000, "word " * 2000, "\x00nul"]


def docs(spark, texts, first=0):
    rows = [(first + k, t, "other", 1.5, "en") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, kept double, lang string")


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


def test_pieces_equal_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ODD + ODD[:2]
    got = {r["doc_id"]: r for r in pieces.encode_documents(docs(spark, texts), MODEL).collect()}
    digests = {r["doc_id"]: r for r in pieces.encode_digests(docs(spark, texts), MODEL).collect()}
    for k, t in enumerate(texts):
        ids = [sp.bos_id(), *sp.encode(t or ""), sp.eos_id()]
        assert got[k]["ids"] == ids and got[k]["decoded"] == sp.decode(ids)
        assert digests[k]["n_tokens"] == len(ids)
        assert digests[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert pieces.encode_documents(docs(spark, texts).limit(0), MODEL).count() == 0


def test_blocks_and_parts_equal_library(spark, monkeypatch):
    """Many blocks that share chunks, some of them alike, and chunks too long for the table."""
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 2000)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = np.random.default_rng(0)
    texts = [prose(rng, int(rng.integers(0, 60)), 300) for _ in range(300)] + ["y" * 400, "z" * 49 + " " + "é" * 48] + ["same text of a block " * 120] * 5
    got = {r["doc_id"]: r for r in pieces.encode_documents(docs(spark, texts).repartition(3, "doc_id").sortWithinPartitions("doc_id"), MODEL, ("doc_id", "kept")).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        ids = [sp.bos_id(), *sp.encode(t), sp.eos_id()]
        assert got[k]["ids"] == ids and got[k]["decoded"] == sp.decode(ids) and got[k]["kept"] == 1.5
    same = docs(spark, texts[:50])
    assert pieces.encode_digests(same.unionByName(same), MODEL).groupBy("doc_id", "ids_sha256").count().where("count = 2").count() == 50


def test_pieces_of_rows_in_no_stable_order(spark, monkeypatch, tmp_path):
    """What a shuffle, a join or a random choice returns is encoded like files are; a part's table that starts again gives the same ids."""
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 500)
    monkeypatch.setattr(pieces, "TABLE", 5)
    rng = np.random.default_rng(8)
    texts = [prose(rng, 1, 60) for _ in range(120)] + ["same words"] * 30
    docs(spark, texts).write.parquet(str(tmp_path / "docs"))
    files = spark.read.parquet(str(tmp_path / "docs"))
    want = {r["doc_id"]: r["ids_sha256"] for r in pieces.encode_digests(files, MODEL).collect()}
    known = pieces.Model(MODEL)
    assert want[0] == hashlib.sha256(np.array([known.begin, *known.model.encode(texts[0]), known.end], "<u4").tobytes()).hexdigest()
    other = files.select("doc_id", F.rand().alias("x"))
    for rows in (files.repartition(7), files.orderBy(F.rand()), files.join(other, "doc_id"), files.where("doc_id >= 0").select("text", "doc_id")):
        assert {r["doc_id"]: r["ids_sha256"] for r in pieces.encode_digests(rows, MODEL).collect()} == want
    assert pieces.encode_digests(files.unionByName(files).repartition(5), MODEL).count() == 300


def test_pieces_of_long_texts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["a" * 1_000_000, " " * 300_000, "word " * 200_000, "漢字" * 100_000, "a\n" * 100_000]
    got = {r["doc_id"]: r["ids_sha256"] for r in pieces.encode_digests(docs(spark, texts), MODEL).collect()}
    for k, t in enumerate(texts):
        ids = [sp.bos_id(), *sp.encode(t), sp.eos_id()]
        assert got[k] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_chunks_pack_and_unpack():
    rng = np.random.default_rng(2)
    strings = ["", "\x00", "▁", "漢字", *(prose(rng, 3) for _ in range(50))]
    assert pieces.unpack_strings(pieces.pack_strings(strings)) == strings and pieces.unpack_strings(pieces.pack_strings([])) == []
    sizes, flat = pieces.unpack_numbers(pieces.pack_segments([[1, 2, 70_000], [], [3]]))
    assert (sizes.tolist(), flat.tolist()) == ([3, 0, 1], [1, 2, 70_000, 3])
    assert [a.tolist() for a in pieces.unpack_numbers(pieces.pack_segments([]))] == [[], []]


def test_length_histogram(spark):
    rng = np.random.default_rng(1)
    n = [0, 0, 5, 7, 7, 3000, *map(int, rng.integers(0, 4000, 300))]
    hist = lengths.length_histogram(spark.createDataFrame([(x,) for x in n], "n_tokens long")).cache()
    for r in hist.collect():
        at = r["length"]
        assert (r["n_docs"], r["docs_ge"], r["docs_le"]) == (n.count(at), sum(x >= at for x in n), sum(x <= at for x in n))
        assert (r["tokens_ge"], r["tokens"], r["tokens_cut"]) == (sum(x for x in n if x >= at), sum(n), sum(min(x, at) for x in n))
    assert {r["limit"]: r["tokens_cut"] for r in lengths.totals(hist, [6, 9999]).collect()} == {6: sum(min(x, 6) for x in n), 9999: sum(n)}
    assert lengths.quantiles(hist, [0.5]).first()["length"] == sorted(n)[(len(n) + 1) // 2 - 1]
    assert lengths.length_histogram(spark.createDataFrame([], "n_tokens long")).count() == 0


def test_token_lengths(spark):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encode = lengths._encoding(path, pattern).encode_ordinary
    got = {r["doc_id"]: r["n_tokens"] for r in lengths.token_lengths(docs(spark, ODD), path, pattern).collect()}
    assert got == {k: len(encode(t or "")) for k, t in enumerate(ODD)}


def test_token_lengths_of_long_runs(spark):
    """Equal to the library wherever it can read the run; and a million blanks, letters or marks are counted."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoding = lengths._encoding(path, pattern)
    count = lengths.counter(encoding)
    n = lengths.LONG_RUN
    for run in (" " * n, "\n" * (n + 1), " \n\t" * n, "\u3000\xa0" * n, "\x1c" * n, " " * (n - 1), "\r\n" * 20000):
        for text in (run, run + "a", "a" + run, f"a{run}b{run}", f"{run}'s 1{run}\n!", f"{run}x {run}\u2003"):
            assert count(text) == len(encoding.encode_ordinary(text)), repr(text[:20])
    texts = [" " * 1_000_000, "\n" * 1_000_000, " \n" * 500_000 + "end", "a" * 1_000_000, "!" * 1_000_000, "word " * 200_000]
    got = {r["doc_id"]: r["n_tokens"] for r in lengths.token_lengths(docs(spark, texts), path, pattern).collect()}
    assert got[0] == len(encoding._encode_single_piece(texts[0])) and got[2] == len(encoding._encode_single_piece(texts[2][:-4])) + len(encoding.encode_ordinary("\nend"))
    assert [got[k] for k in (3, 4, 5)] == [len(encoding.encode_ordinary(texts[k])) for k in (3, 4, 5)]


def test_slices_hold_bytes_and_keep_order():
    import pyarrow as pa

    from skein.llm.batches import slices

    texts = ["a" * int(n) for n in np.random.default_rng(0).integers(0, 4000, 3000)] + ["b" * 100_000]
    parts = list(slices([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])], 512, 50_000))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows == 1 or p.nbytes <= 50_000 for p in parts) and max(p.num_rows for p in parts) <= 512


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "# a \\ <b> </turn>\n### x\n"), (2, 5, "assistant", None), (2, 3, None, "q\n"), (None, 1, "user", "n"), (None, None, "user", "first"),
    (3, 0, "ro\nle", "\\n"), (3, 1, "assistant", "dup"), (3, 1, "assistant", "dup"), (3, 2, "assistant", "")
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame([(*t, "extra") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_conversations(rows)
    back = {r["tree"]["conv_id"] if not r["tree"]["none"] else None: r for r in chat.read_back(formatted, ["tree"]).collect()}
    texts = {r["tree"]["conv_id"] if not r["tree"]["none"] else None: r for r in formatted.collect()}
    assert len(back) == 4
    for conv, row in back.items():
        turns = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        want = [(t[2] or "", t[3] or "") for t in turns]
        assert chat.parse_turns(texts[conv]["formatted"]) == want
        loss = "".join(x for r, x in want if r == "assistant")
        assert (row["n_turns"], row["loss_chars"], row["formatted_chars"]) == (len(want), len(loss), len(texts[conv]["formatted"]))
        assert row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_conversations(rows.limit(0)).count() == 0


def test_reply_trees(spark):
    # 1 -> 2 -> 3, 1 -> 4 -> 5 -> 6; a second root 7; a cycle 8 <-> 9; an orphan 10; and one long chain.
    m = [(1, None, 0.0), (2, 1, 1.0), (3, 2, 1.0), (4, 1, 0.5), (5, 4, 0.5), (6, 5, 2.0), (7, None, None), (8, 9, 1.0), (9, 8, 1.0), (10, 99, 1.0)]
    chain = [(100 + k, 99 + k if k else None, 1.0) for k in range(70)]
    rows = spark.createDataFrame([(t, *r, "user", f"m{r[0]}") for t, part in ((1, m), (2, chain)) for r in part], "tree long, id long, parent long, score double, role string, text string")
    got = {(r["tree"], r["root"]): [t for _, t in chat.parse_turns(r["formatted"])] for r in chat.format_paths(rows).collect()}
    assert got == {(1, 1): ["m1", "m4", "m5", "m6"], (1, 7): ["m7"], (1, 10): ["m10"], (2, 100): [f"m{100 + k}" for k in range(70)]}
    assert chat.format_paths(rows, keep=2).count() == 5


def brute_paths(messages, keep):
    """Chosen paths of one tree (id: parent, score) by walking up from each leaf."""
    parents = {k: p if p in messages else None for k, (p, _) in messages.items()}
    branches = {}
    for leaf in messages.keys() - set(parents.values()):
        path, at = [], leaf
        while at is not None and at not in path:
            path.append(at)
            at = parents[at]
        if at is None:
            branches.setdefault(path[-1], []).append((-sum(messages[m][1] or 0 for m in path), -len(path), leaf, path[::-1]))
    return {(root, rank + 1): b[3] for root, some in branches.items() for rank, b in enumerate(sorted(some)[:keep])}


def test_reply_trees_equal_brute_force(spark):
    """Branching trees with scores, ties, cycles, orphans and repeated messages."""
    rng = np.random.default_rng(13)
    trees = {}
    for tree in range(25):
        n = int(rng.integers(1, 40))
        back = {k: int(rng.integers(0, k)) if k and rng.random() < 0.9 else None for k in range(n)}
        trees[tree] = {k: (p if rng.random() > 0.03 else int(rng.integers(0, n + 5)), rng.choice([None, 0.5, 1.0, -1.0])) for k, p in back.items()}
    rows = [(t, k, p, s, "assistant" if k % 2 else "user", f"m{k} <#\\> \n") for t, m in trees.items() for k, (p, s) in m.items()]
    rows += rows[:30] + [(None, 1, None, 1.0, "user", "x"), (3, None, None, 1.0, "user", "x")]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "tree long, id long, parent long, score double, role string, text string, leaf string")
    got = {(r["tree"], r["root"], r["rank"]): chat.parse_turns(r["formatted"]) for r in chat.format_paths(frame, keep=3).collect()}
    want = {}
    for t, m in trees.items():
        for (root, rank), path in brute_paths(m, 3).items():
            want[t, root, rank] = [("assistant" if k % 2 else "user", f"m{k} <#\\> \n") for k in path]
    assert got == want


def test_long_conversations(spark):
    """Thousands of turns, a text of a megabyte, one repeated row many times, and several texts at one turn."""
    rows = [(1, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(5000)] + [(2, 0, "user", "# <\\" * 250_000), (2, 1, "assistant", "y")]
    rows += [(3, 0, "assistant", "same")] * 700 + [(4, 0, "user", f"{9 - k}") for k in range(10)] + [(4, None, "user", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["tree"]["conv_id"]: chat.parse_turns(r["formatted"]) for r in chat.format_conversations(frame).collect()}
    assert got[1] == [r[2:] for r in rows[:5000]] and got[2] == [r[2:] for r in rows[5000:5002]]
    assert got[3] == [("assistant", "same")] * 700 and got[4] == [("user", ""), *(("user", str(k)) for k in range(10))]


def labelled(spark, kind):
    rng = np.random.default_rng(11)
    texts, marks = [], []
    for k in range(900):
        bad = k % 3 == 0
        words = prose(rng, 60, 400).split()
        if bad and kind == "quality":
            words = [w.upper() + "!!" for w in words]
        if bad and kind == "toxic":
            for at in rng.integers(0, 60, 4):
                words[at] = f"vile{rng.integers(0, 40)}"
        texts.append(" ".join(words))
        marks.append(int(bad) if kind == "toxic" else int(not bad))
    rows = [(k, m) for k, m in enumerate(marks)]
    return texts, marks, spark.createDataFrame([*rows, (0, marks[0]), (9999, 1), (7, None), (None, 1)], f"doc_id long, {kind} int")


@pytest.mark.parametrize(("module", "kind", "parts"), [(quality, "quality", (3, 1)), (toxicity, "toxic", (4, 2))])
def test_classifiers_on_held_out_rows(spark, module, kind, parts):
    from skein.llm.batches import fold_of

    texts, marks, labels = labelled(spark, kind)
    rows = docs(spark, texts + [None, "", "x" * 5000])
    model = module.train(rows, labels)
    got = {r["doc_id"]: r["score"] for r in module.score_documents(rows.unionByName(rows.where("doc_id = 1")), model).collect()}
    out = [k for k in range(len(texts)) if fold_of(k, parts[0]) == parts[1]]
    right = np.mean([(got[k] >= module.THRESHOLD) == (marks[k] == 1) for k in out])
    assert right > 0.93 and all(0 <= s <= 1 for s in got.values()) and abs(got[900] - got[901]) < 1e-5
    kept = (module.keep_good if kind == "quality" else module.keep_clean)(rows, model)
    want = {k for k, s in got.items() if (s >= module.THRESHOLD) == (kind == "quality")}
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.collect()} == want
    none = module.train(rows, labels.limit(0))
    assert module.score_documents(rows, none).count() == len(texts) + 3
    assert module.score_documents(rows.limit(0), model).count() == 0
