"""Greedy string tiling against a tiling that tries all positions."""

import re
import resource

import numpy as np
import pytest

from skein.llm import decontaminate


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "other", 1.5, "en") for k, t in enumerate(texts)], "doc_id long, text string, item_id string, coverage double, t1 string")


def items(spark, rows):
    return spark.createDataFrame([(k, t, 7) for k, t in rows], "item_id long, text string, hash int")


def brute_tiles(doc, item):
    """Greedy tiling by trying all positions."""
    used_d, used_i, out = [False] * len(doc), [False] * len(item), []
    while item:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and not used_d[d + n] and not used_i[i + n]:
                    n += 1
                if n > best[0]:
                    best = (n, d, i)
        if best[0] < min(decontaminate.TILE, len(item)):
            break
        n, d, i = best
        used_d[d : d + n], used_i[i : i + n] = [True] * n, [True] * n
        out.append(best)
    return out


def test_tiles_equal_brute_force():
    rng, code = np.random.default_rng(5), decontaminate.Coder()
    for k in range(60):
        size = int(rng.choice([1, 2, 3, 4, 5, 9, 40]))
        item = [f"x{v}" for v in rng.integers(0, 1 + k % 4, size)]
        cuts = sorted(rng.integers(0, size + 1, 3))
        doc = [f"x{v}" for v in rng.integers(0, 1 + k % 4, 30)] + item[cuts[1] : cuts[2]] + item[cuts[0] : cuts[1]] + item[5:25]
        assert decontaminate.tiles(code(" ".join(doc)), code(" ".join(item))) == brute_tiles(doc, item)


@pytest.mark.parametrize("common", [decontaminate.COMMON, 2, 0])
def test_documents_equal_brute_force(spark, monkeypatch, common):
    """All pairs of documents and items, of one word and more, with equal items, null ids and texts, whichever seeds count as common."""
    monkeypatch.setattr(decontaminate, "COMMON", common)
    rng = np.random.default_rng(6)
    bench = [(k, prose(rng, int(rng.choice([1, 2, 3, 4, 5, 6, 12, 30])), 25)) for k in range(25)]
    bench += [(40, bench[0][1]), (None, bench[3][1]), (None, None), (41, ""), (42, "..."), (1, prose(rng, 20, 25))]
    texts = [prose(rng, int(rng.integers(0, 60)), 25) for _ in range(50)] + [None, "", " ".join(t or "" for _, t in bench)]
    for _ in range(30):
        words = (bench[int(rng.integers(0, 25))][1]).split()
        at = int(rng.integers(0, len(words)))
        texts.append(prose(rng, 20) + " " + " ".join(words[at:]).upper() + "! " + prose(rng, 5) + ", " + " ".join(words[:at]))
    texts += texts[:4]
    got = {r["doc_id"]: r for r in decontaminate.judge_documents(docs(spark, texts), items(spark, bench)).collect()}
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        found = []
        for key, item in bench:
            if split(item):
                made = brute_tiles(split(t), split(item))
                share = sum(n for n, _, _ in made) / len(split(item))
                if share >= 0.5:
                    found.append((-share, key is None, key or 0, key, len(made)))
        best = min(found, default=None)
        r = got[k]
        assert (r["contaminated"], r["item_id"], round(-r["coverage"], 9), r["n_tiles"]) == ((True, best[3], round(best[0], 9), best[4]) if best else (False, None, 0, 0)), k
    kept = decontaminate.keep_clean(docs(spark, texts), items(spark, bench))
    assert kept.columns == docs(spark, texts).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [k for k in got if not got[k]["contaminated"]]


def test_common_phrases_make_no_pairs(spark, monkeypatch):
    """Items and documents that share a line; one document holds an item whole, one only its end, one the line and its end."""
    rng = np.random.default_rng(9)
    line = " ".join(f"c{k}" for k in range(12))
    bench = [(k, line + " " + prose(rng, 28)) for k in range(60)]
    texts = [prose(rng, 60) + " " + line + " " + prose(rng, 60) for _ in range(240)]
    end = " ".join(bench[7][1].split()[-20:])
    texts += [bench[5][1], "x " + end, line + " y " + " ".join(bench[9][1].split()[-8:]), line + " z " + " ".join(bench[11][1].split()[-7:])]
    tiled, tile = [], decontaminate._tiled
    monkeypatch.setattr(decontaminate, "_tiled", lambda pairs, *rest: tiled.append(pairs.count()) or tile(pairs, *rest))
    got = decontaminate.judge_documents(docs(spark, texts), items(spark, bench)).where("contaminated")
    assert {r["doc_id"]: (r["item_id"], round(r["coverage"], 6), r["n_tiles"]) for r in got.collect()} == {240: (5, 1.0, 1), 241: (7, 0.5, 1), 242: (9, 0.5, 2)}
    assert tiled[0] <= 10  # of 14,640


def test_left_out_seeds_cover_less_than_needed():
    rng, code = np.random.default_rng(4), decontaminate.Coder()
    for _ in range(200):
        words = code(" ".join(f"x{v}" for v in rng.integers(0, 3, int(rng.integers(1, 40)))))
        size = min(decontaminate.TILE, len(words))
        seeds, need = decontaminate.rolling(words, size), decontaminate.needed(len(words), float(rng.choice([0.2, 0.5, 1.0])))
        common = rng.permutation(np.unique(seeds))[: int(rng.integers(0, 8))]
        covered, stay = decontaminate.leave_out(seeds, size, need, common)
        union = {p + j for p in np.flatnonzero(~stay) for j in range(size)}
        assert union == set(np.flatnonzero(covered)) and len(union) < need
        assert not set(seeds[~stay]) & set(seeds[stay]) and set(seeds[~stay]) <= set(common)


def test_reordered_passages_and_thresholds(spark):
    rng = np.random.default_rng(3)
    item = [f"b{k}" for k in range(40)]
    half = " ".join(item[20:] + item[:20])
    texts = [prose(rng, 200) + " " + " ".join(item).upper() + "! " + prose(rng, 50), prose(rng, 20) + ", " + half, prose(rng, 400), " ".join(item[:12]), None, "", "a b"]
    texts += [" ".join(item[a] for a in rng.permutation(40)), (" ".join(item) + " ") * 50]
    bench = items(spark, [(2, " ".join(item)), (1, " ".join(item)), (5, "b1 b9"), (None, None), (4, prose(rng, 30))])
    got = {r["doc_id"]: r for r in decontaminate.judge_documents(docs(spark, texts), bench).collect()}
    assert [k for k in got if got[k]["contaminated"]] == [0, 1, 8]
    assert (got[0]["item_id"], got[0]["coverage"], got[0]["n_tiles"]) == (1, 1.0, 1) and got[1]["n_tiles"] == 2
    low = {r["doc_id"]: r for r in decontaminate.judge_documents(docs(spark, texts), bench, 0.3).collect()}
    assert low[3]["contaminated"] and abs(low[3]["coverage"] - 0.3) < 1e-9
    with pytest.raises(ValueError):
        decontaminate.judge_documents(docs(spark, texts), bench, 0.0)


@pytest.mark.parametrize("bits", [None, 4])
def test_empty_tables_and_full_filters(spark, monkeypatch, bits):
    """A filter in which every bit is set passes everything on to the join; results are the same."""
    if bits:
        monkeypatch.setattr(decontaminate, "LEAST_BITS", 8)
        monkeypatch.setattr(decontaminate, "MOST_BITS", 8)
    rng = np.random.default_rng(8)
    bench = [(k, prose(rng, 25)) for k in range(40)]
    texts = [prose(rng, 60) + " " + bench[k][1] if k % 3 == 0 else prose(rng, 80) for k in range(40)]
    got = decontaminate.judge_documents(docs(spark, texts), items(spark, bench))
    assert {r["doc_id"]: r["item_id"] for r in got.collect()} == {k: k if k % 3 == 0 else None for k in range(40)}
    assert decontaminate.judge_documents(docs(spark, texts), items(spark, [])).where("contaminated").count() == 0
    assert decontaminate.judge_documents(docs(spark, []), items(spark, bench)).count() == 0
    assert decontaminate.keep_clean(docs(spark, texts), items(spark, [])).count() == 40 and decontaminate.keep_clean(docs(spark, []), items(spark, bench)).count() == 0


def test_long_repetitive_texts_take_little_memory(spark):
    code = decontaminate.Coder()
    doc, item = code("word " * 200_000), code("word " * 200)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert decontaminate.tiles(doc, item) == [(200, 0, 0)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB
    line = "one two three four five six seven " * 30_000
    found = decontaminate.judge_documents(docs(spark, ["word " * 200_000, line, "x" * 1_000_000]), items(spark, [(1, "word " * 200), (2, "six seven one two three four five " * 3)]))
    assert {r["doc_id"]: r["item_id"] for r in found.collect()} == {0: 1, 1: 2, 2: None}
