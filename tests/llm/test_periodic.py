"""Periodic runs against a search over all starts and periods, and lag counts against counting."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import periodic
from skein.llm.queries import QUERIES


def naive_runs(words, least=6, repeats=4):
    """Every maximal stretch with its smallest period."""
    n, out = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, repeats * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, m, q) for (s, m), q in out.items())


def naive_kept(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]


def found(texts, **more):
    words, bounds, names = periodic.number_words(texts)
    return periodic.find_runs(words, bounds, **more), names


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), max_size=4))
def test_few_words(texts):
    runs, _ = found([" ".join(t) for t in texts])
    assert runs == [naive_runs(t) for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_planted_runs_and_counts(seed):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(12):
        t = [f"w{int(x)}" for x in rng.zipf(1.4, int(rng.integers(0, 400))) % 50]
        for _ in range(int(rng.integers(0, 4))):
            period = [f"v{int(x)}" for x in rng.integers(0, 3 + seed, int(rng.integers(1, 60)))]
            t[len(t) // 2 : len(t) // 2] = (period * 12)[: int(rng.integers(1, 12 * len(period)))]
        texts.append(t)
    words, bounds, _ = periodic.number_words([" ".join(t) for t in texts])
    counts, at = periodic.lag_matches(words, bounds, 4)
    for d, t in enumerate(texts):
        assert [sum(a == b for a, b in zip(t, t[q:])) for q in range(1, len(t) // 4 + 1)] == counts[at[d] + 1 : at[d + 1]].tolist()
    assert periodic.find_runs(words, bounds) == [naive_runs(t) for t in texts]


def test_frequent_words_are_counted_by_transforms(monkeypatch):
    calls = []
    real = np.fft.rfft
    monkeypatch.setattr(np.fft, "rfft", lambda *a: calls.append(1) or real(*a))
    text = ["a", "b", "c"] * 200 + ["a"] * 300
    runs, _ = found([" ".join(text)])
    assert calls and runs == [naive_runs(text)]


def test_long_texts_stay_quick():
    text = "x " * 400_000 + "y z " * 100_000
    runs, _ = found([text])
    assert runs == [[(0, 400_000, 1), (400_000, 200_000, 2)]]
    rng = np.random.default_rng(1)
    two = " ".join(map("ab".__getitem__, rng.integers(0, 2, 60_000)))  # every lag has matches enough
    assert all(m >= max(6, 4 * q) for s, m, q in found([two])[0][0])


def test_words_split_at_ascii_blanks_only_and_in_pieces(monkeypatch):
    monkeypatch.setattr(periodic, "PIECE", 7)
    text = " a\x1cb  c\t\r\nd　e " * 9
    words, bounds, names = periodic.number_words([text, "", "  "])
    assert [names[w] for w in words] == re.findall(r"[^\x20\x09-\x0D]+", text) and bounds.tolist() == [0, len(words), len(words), len(words)]


def test_table_with_special_rows(spark):
    rows = [(1, "a b " * 5 + "c", "k"), (1, "a b " * 5 + "c", "k"), (2, None, None), (None, "", "x"), (3, " \t\n", "y"), (4, "q " * 6, "z"), (5, "one two", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(docs).collect()), key=str)
    ab = (1, 11, [(0, 10, 2)], "a b c")
    assert got == sorted([ab, ab, (2, 0, [], ""), (None, 0, [], ""), (3, 0, [], ""), (4, 6, [(0, 6, 1)], "q"), (5, 2, [], "one two")], key=str)
    assert periodic.periodic_runs(docs.limit(0)).collect() == []
    wide = periodic.periodic_runs(docs, least=20).collect()
    assert all(not r["runs"] for r in wide)


def test_query_against_its_contract(spark):
    data = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, data).collect()}
    assert set(got) == set(docs)
    planted = 0
    for k, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(k).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            planted += 1
        if n > 3000:  # the search is quadratic
            continue
        runs = naive_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        row = got[k]
        assert (row["start"], row["length"], row["period"]) == (best or (None,) * 3) and row["n_runs"] == len(runs)
        assert row["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(" ".join(naive_kept(words, runs)).encode()).hexdigest()
    assert planted
