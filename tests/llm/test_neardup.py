"""Near-duplicate classes against brute-force weighted Jaccard similarity of TF-IDF shingles."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from skein.llm import batches, neardup


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "other", 1, "x") for k, t in rows], "doc_id long, text string, node string, k1 int, lang string")


def shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    return Counter(tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))) if words else Counter()


def tfidf(texts):
    """Weighted shingles of each text; frequencies are of one text for each least hash."""
    plain, least = [shingles(t) for t in texts], {}
    found, _, starts, _ = neardup.Shingler()([t or "" for t in texts])
    for k in range(len(texts)):
        if plain[k]:
            least.setdefault(int(found[starts[k] : starts[k + 1]].min()), []).append(k)
    # Which of a group's rows is counted is the operator's choice, so groups in the fixtures differ in rare shingles only.
    counted = [g[0] for g in least.values()]
    df = Counter(s for k in counted for s in plain[k])
    return [{s: n * (1 + math.log((len(counted) + 1) / (max(1, df[s]) + 1))) for s, n in p.items()} for p in plain]


def jaccard(a, b):
    common = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return common / (sum(a.values()) + sum(b.values()) - common)


def brute_force(texts):
    """Least index of each text's class, and similarities too near the threshold to tell."""
    weighted, root, unsure = tfidf(texts), list(range(len(texts))), 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if weighted[a] and weighted[b]:
                s = jaccard(weighted[a], weighted[b])
                unsure += 0.785 < s < 0.815
                if s >= 0.8:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))], unsure


def corpus(rng):
    """Groups of near copies with a few words changed each, others half alike, and unlike ones."""
    texts = []
    for size in (40, 25, 12, 6, 3, 2):
        base = prose(rng, 140).split()
        for k in range(size):
            words = list(base)
            for at in rng.integers(0, 140, int(rng.choice([0, 1, 2, 12, 30], p=[0.2, 0.3, 0.2, 0.1, 0.2]))):
                words[at] = f"z{size}_{k}_{at}"
            texts.append(" ".join(words))
    shared = prose(rng, 60)
    texts += [prose(rng, 60) + " " + shared for _ in range(15)] + [prose(rng, 90) for _ in range(20)]
    return texts + ["short one", "Short, one!", "short one two", None, "", "", "...", texts[0].upper().replace(" ", ", ")]


@pytest.mark.parametrize("block", [1500, 6])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)  # so that buckets are dealt out in several blocks
    texts = corpus(np.random.default_rng(7))
    want, unsure = brute_force(texts)
    rows = frame(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r for r in neardup.near_duplicates(rows).collect()}
    differing = [k for k in got if got[k]["class_id"] != want[k]]
    assert len(differing) <= unsure // 20, (differing, unsure)
    assert all(r["kept"] == (r["class_id"] == k) for k, r in got.items())
    assert sorted(r["doc_id"] for r in neardup.keep_one_of_each(rows).collect()) == sorted({r["class_id"] for r in got.values()})


def test_full_comparison_alone_finds_all_links(spark, monkeypatch):
    """Without stars, everything is left to the comparison in blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 5)
    texts = corpus(np.random.default_rng(8))[:80]
    with_stars = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(frame(spark, list(enumerate(texts)))).collect()}
    monkeypatch.setattr(neardup, "STARS", 0)
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(frame(spark, list(enumerate(texts)))).collect()} == with_stars


def test_rows_of_one_id_lose_nothing(spark):
    a, b = prose(np.random.default_rng(1), 50), prose(np.random.default_rng(2), 50)
    rows = frame(spark, [(3, b), (5, a), (5, b), (7, a), (7, a), (None, a), (None, None), (None, ""), (9, ""), (9, None)])
    kept = [(r["doc_id"], r["text"]) for r in neardup.keep_one_of_each(rows).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(3, b), (5, a), (None, kept[[k[0] for k in kept].index(None)][1]), (9, kept[[k[0] for k in kept].index(9)][1])]))
    found = neardup.near_duplicates(rows).collect()
    assert len(found) == 10 and sorted((r["doc_id"], r["class_id"]) for r in found if r["doc_id"]) == [(3, 3), (5, 3), (5, 5), (7, 5), (7, 5), (9, 9), (9, 9)]
    nameless = frame(spark, [(None, a), (None, b), (None, a)])
    assert [r["class_id"] for r in neardup.near_duplicates(nameless).collect()] == [None] * 3
    assert sorted(r["text"] for r in neardup.keep_one_of_each(nameless).collect()) == sorted([a, b])


def test_one_id_on_all_rows(spark):
    rng = np.random.default_rng(4)
    texts = [prose(rng, 40) for _ in range(60)]
    rows = frame(spark, [(1, t) for t in texts + texts[:20]])
    assert sorted(r["text"] for r in neardup.keep_one_of_each(rows).collect()) == sorted(texts)


def test_empty_and_long(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0 and neardup.keep_one_of_each(frame(spark, [])).count() == 0
    long = [prose(np.random.default_rng(3), 100_000), "x" * 300_000, "word " * 100_000]
    rows = frame(spark, list(enumerate([*long, long[0] + " end", long[2] + "word", None])))
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(rows).collect()} == {0: 0, 1: 1, 2: 2, 3: 0, 4: 2, 5: 5}
    kept = neardup.keep_one_of_each(rows)
    assert kept.columns == rows.columns and kept.count() == 4


def test_copies_do_not_make_their_words_common(spark):
    """A group of near copies counts some times fewer than it has members."""
    rng = np.random.default_rng(5)
    base = prose(rng, 200).split()
    texts = []
    for k in range(300):
        words = list(base)
        words[int(rng.integers(0, 200))] = f"z{k}"
        texts.append(" ".join(words))
    weights = neardup.document_frequencies(frame(spark, list(enumerate(texts + [prose(rng, 100) for _ in range(50)]))))
    assert 50 <= weights.docs <= 100
    common, _, _, _ = neardup.Shingler()([" ".join(base)])
    assert np.median(weights(common, np.ones(len(common)))) > 1.5


def test_every_row_counts_its_share(spark):
    """Rows with one least shingle hash count equal parts of one, whatever else they hold; rows alike in all are rows too."""
    rng = np.random.default_rng(6)
    base = prose(rng, 60)
    texts = [f"{base} {prose(rng, 2 * k)}" for k in range(12)]
    texts += [texts[3], prose(rng, 80), prose(rng, 500), "", None]
    rows = [*enumerate(texts), (3, texts[3])]
    split = [t or "" for _, t in rows]
    found, _, starts, _ = neardup.Shingler()(split)
    groups = [found[a:b].min() if b > a else None for a, b in zip(starts[:-1], starts[1:], strict=True)]
    alike = Counter(groups)
    assert max(n for g, n in alike.items() if g is not None) > 3
    want = sum((b - a) / alike[g] for g, a, b in zip(groups, starts[:-1], starts[1:], strict=True) if g is not None)
    weights = neardup.document_frequencies(frame(spark, rows))
    assert weights.docs == len(alike) - 1
    assert [float(s.sum(dtype=np.float64)) for s in weights.sketch] == pytest.approx([want, want], rel=1e-5)


def test_sampling_estimates_weighted_similarity():
    rng = np.random.default_rng(9)
    sampler, agree, exact = neardup.Sampler(), [], []
    for _ in range(30):
        common = rng.integers(0, 2**62, 150, dtype=np.uint64)
        parts = [np.sort(np.append(common, rng.integers(0, 2**62, 30, dtype=np.uint64))) for _ in range(2)]
        weight = dict(zip(common.tolist(), rng.uniform(1, 9, 150), strict=True))
        both = [(p, np.array([weight.get(h, 6.0) for h in p.tolist()], np.float32)) for p in parts]
        drawn = [sampler(h, w, np.array([0, len(h)]))[0] for h, w in both]
        agree.append((drawn[0] == drawn[1]).mean())
        exact.append(neardup.similarity(*((h, w, float(w.sum())) for h, w in both)))
    assert abs(np.mean(agree) - np.mean(exact)) < 0.03


def test_links_between_blocks_only():
    f = [(np.arange(k, k + 100, dtype=np.uint64), np.ones(100, np.float32), 100.0) for k in (0, 1, 2, 60)]
    assert neardup.link_texts([1, 2, 3, 4], [1, 2, 3, 4], f) == [(1, 2), (1, 3)]
    assert neardup.link_texts([1, 2, 3, 4], [1, 2, 3, 4], f, [0, 0, 1, 1]) == [(1, 3), (2, 3)]
    assert neardup.link_texts([1, 2, 3, 4], [1, 1, 1, 4], f) == []


def test_sketch_is_bounded(spark):
    rows = frame(spark, [(0, "a b c d e f")])
    assert neardup.document_frequencies(rows).sketch.shape == (neardup.SKETCH_DEPTH, 1 << neardup.LEAST_BITS)


def test_frequencies_read_only_rows_with_others_again(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(12)
    copied = prose(rng, 80)
    texts = [prose(rng, 80) for _ in range(30)] + [copied] * 4 + ["", None]
    log = str(tmp_path / "texts")

    def counted(batch, column="text"):
        found = [t or "" for t in batch.column(column).to_pylist()]
        with open(log, "a") as f:
            f.write("x" * len(found))
        return found

    for module in (neardup, batches):
        monkeypatch.setattr(module, "texts_of", counted)
    weights = neardup.document_frequencies(frame(spark, list(enumerate(texts))))
    with open(log) as f:
        assert len(f.read()) == len(texts) + 4
    found, counts, starts, _ = neardup.Shingler()([texts[0], copied])
    cells = neardup._cells(found, weights.bits)
    assert weights.docs == 31 and np.allclose(np.minimum(*(row[at] for row, at in zip(weights.sketch, cells, strict=True))), 1, atol=1e-5)
