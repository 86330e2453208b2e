"""Packing: ids against the tokenizer, the algorithm against optimal and best-fit packings, and the tables' contract."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import packing
from skein.llm.queries import QUERIES

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


ENCODER = packing.Encoder(RANKS, PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", " ", "  ", "\n", "\t", "don't", "'ll", "'", "Wort", "1234", "é", "　", "\x85", "\x1c", "漢字", "...", "<|", "​", "a", "Zz", "🎉", "́"]), max_size=25))
def test_ids_equal_the_tokenizer(tokenizer, some):
    text = "".join(some)
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids_of(tokenizer, text)


def test_long_texts_in_parts(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "PIECE", 50)
    text = "Ein Satz, 12 words  and\n\nmore. " * 40 + " " * 3000 + "x" + "\t" * 1500
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids_of(tokenizer, text)
    assert len(ENCODER.encode(" " * 1_000_000)) > 0


def solve(lengths, capacity, turns=6):
    lengths = np.sort(np.array(lengths))[::-1]
    islands = [packing.Island(lengths, capacity, [7, 0, k, 0]) for k in range(3)]
    state = [i.evolve([], None, packing.CHILDREN) for i in islands]
    first = -islands[0].fitness(islands[0].start()[0])[0]
    for _ in range(turns):
        state = [i.evolve(s, state[k - 1][0], packing.CHILDREN) for k, (i, s) in enumerate(zip(islands, state))]
    best = max((s[0] for s in state), key=islands[0].fitness)
    assert (np.bincount(best, weights=lengths) <= capacity).all()
    return len(np.unique(best)), first, islands[0].bound


def smallest(lengths, capacity):
    """Bins of the best packing, by trying all."""
    best = len(lengths)

    def go(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(lengths):
            best = len(free)
            return
        for b in {f: i for i, f in enumerate(free) if f >= lengths[k]}.values():
            free[b] -= lengths[k]
            go(k + 1, free)
            free[b] += lengths[k]
        go(k + 1, [*free, capacity - lengths[k]])

    go(0, [])
    return best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_few_pieces_are_packed_best(lengths):
    lengths = sorted(lengths, reverse=True)
    best = smallest(lengths, 20)
    got, _, bound = solve(lengths, 20, 2)
    assert bound <= best == got


def test_crossover_beats_best_fit_where_bins_fill_exactly():
    """Triplets that fill bins: best fit from long to short opens more bins than are needed."""
    rng = np.random.default_rng(5)
    lengths = []
    for _ in range(40):
        a = int(rng.integers(380, 490))
        b = int(rng.integers(250, (1000 - a) // 2 + 1))
        lengths += [a, b, 1000 - a - b]
    got, first, bound = solve(lengths, 1000, 25)
    assert bound == 40 and got < first


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(2)
    island = packing.Island(np.sort(rng.integers(1, 2048, 500))[::-1], 2048, [1, 0, 0, 0])
    some = island.start()
    for _ in range(30):
        for child in (island.cross(some[0], some[-1]), island.mutate(some[3])):
            assert len(child) == 500 and (np.bincount(child, weights=island.lengths) <= 2048).all() and (np.bincount(child) > 0).all()
            some[-1] = child
    again = packing.Island(island.lengths, 2048, [1, 0, 0, 0])
    assert all((a == b).all() for a, b in zip(again.evolve([], None, 20), packing.Island(island.lengths, 2048, [1, 0, 0, 0]).evolve([], None, 20)))


def check_sequences(rows, capacity):
    """Gapless offsets from 0 in each sequence; number of sequences."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], max(r["length"] or 0, 0)))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity or len(own) == 1
    return len(by)


def test_levels_pack_what_problems_leave(spark, monkeypatch):
    monkeypatch.setattr(packing, "PROBLEM", 120)
    rng = np.random.default_rng(4)
    rows = [(int(k), int(n)) for k, n in enumerate(rng.integers(1, 300, 1500))]
    got = packing.pack(spark.createDataFrame(rows, "k long, length long"), 512).collect()
    assert sorted((r["k"], r["length"]) for r in got) == rows
    total = check_sequences(got, 512)
    bound = packing.lower_bound(np.array([n for _, n in rows]), 512)
    assert len({r["sequence_id"] >> 50 for r in got}) > 1 and bound <= total <= bound + 3  # of 13 problems that are each rounded up


def test_special_rows(spark):
    rows = [(1, 5, "a"), (1, 5, "a"), (2, None, "b"), (3, 0, "c"), (4, -2, "d"), (5, 99, "e"), (6, 10, None), (None, 3, "f")]
    frame = spark.createDataFrame(rows, "k long, length long, node string")
    got = packing.pack(frame, 10)
    assert set(got.columns) == {"k", "length", "node", "sequence_id", "offset"}
    got = got.collect()
    assert sorted(((r["k"], r["length"], r["node"]) for r in got), key=str) == sorted(rows, key=str)
    assert check_sequences(got, 10) == 4  # 99; 10; 5 + 5 (or + 3); the other
    assert packing.pack(frame.limit(0), 10).collect() == []


def test_query_against_its_contract(spark, tokenizer):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = QUERIES["op13_best_fit_packing"](spark, DATA).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(docs)
    lengths = []
    for k, text in docs.items():
        ids = [*ids_of(tokenizer, text), 0]
        own = sorted(pieces[k], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 2048))) and all(r["length"] == 2048 for r in own[1:])
        at = 0
        for r in own:
            part = ids[at : at + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
            lengths.append(r["length"])
        assert at == len(ids)
    assert check_sequences(got, 2048) == packing.lower_bound(np.array(lengths), 2048)


def test_sequences_hold_the_ids(spark, tokenizer):
    docs = spark.createDataFrame([(1, "some words here"), (2, None), (3, "x " * 3000)], "doc_id long, text string")
    packed = packing.pack_documents(docs, RANKS, PATTERN, with_ids=True)
    got = sorted(len(r["ids"]) for r in packing.sequences(packed).collect())
    whole = [i for r in packing.sequences(packed).collect() for i in r["ids"]]
    assert sorted(whole) == sorted([*ids_of(tokenizer, "some words here"), 0, 0, *ids_of(tokenizer, "x " * 3000), 0])
    assert got[-1] == 2048 and max(got) <= 2048
