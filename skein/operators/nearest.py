"""The users most like those who request something, by blocks of users.

A task holds the ratings of a block of users that request something, and their requests; the ratings of all users that have to do with the block's items pass by it, packed, each user's in
one piece. So a rating moves once for each block that meets its item, and what a task holds is one block and what it has found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bits of a word that names blocks; neighbours found that a task holds at once; rows of a batch that it returns.
BITS, FOUND, BATCH = 62, 1_000_000, 50_000
#: Kinds of pieces, in the order in which a task gets them: ratings of its block, requests of its block, ratings that pass by.
OURS, WANTED, PASSING = range(3)
SENT = "p int, q int, kind int, u binary, i binary, e binary, norm binary"


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers as their least and what they are above it, in 32 bits if that is enough."""
    low = int(x.min()) if len(x) else 0
    small = not len(x) or int(x.max()) - low < 1 << 32
    return np.array([low, small], np.int64).tobytes() + (x - low).astype(np.uint32 if small else np.int64).tobytes()


def _widened(data: bytes) -> np.ndarray:
    low, small = np.frombuffer(data, np.int64, 2)
    return np.frombuffer(data, np.uint32 if small else np.int64, offset=16).astype(np.int64) + low


def _runs(u: np.ndarray) -> np.ndarray:
    """For sorted ids the number of each one's run."""
    return np.concatenate([[0], np.cumsum(np.diff(u) != 0)]) if len(u) else np.zeros(0, np.int64)


def expand(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``n`` places from ``first`` the range's number and the place, one by one."""
    left = np.repeat(np.arange(len(n)), n)
    return left, np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


def sender(bounds: list, parts: int):
    """Packs rows (``u, i, e`` and words ``m0, m1, ...`` of the blocks that meet the item) that come by ``u`` and ``i``; a row without ``e`` is a request. Passing ratings of a block go to ``parts`` tasks."""
    bounds = np.array(bounds, np.int64)

    def pack(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        u, i, e, asks, *words = (np.concatenate(c) for c in zip(*held, strict=True))
        run = _runs(u)
        count = [np.bincount(run, x) for x in (~asks, asks)]
        norm = np.sqrt(np.bincount(run, np.where(asks, 0.0, e * e)))
        block = np.searchsorted(bounds, u)
        both = ((count[0] > 0) & (count[1] > 0))[run]  # users without ratings are like nobody, users without requests ask nothing
        out: list[tuple] = []

        def put(p: int, q: int, kind: int, at: np.ndarray) -> None:
            if len(at):
                first = at[np.flatnonzero(np.diff(run[at], prepend=-1))]
                out.append((p, q, kind, _narrow(u[at]), _narrow(i[at]), b"" if kind == WANTED else e[at].tobytes(), norm[run[first]].tobytes()))

        for p in np.unique(block[both]).tolist():
            for kind, what in ((OURS, ~asks), (WANTED, asks)):
                at = np.flatnonzero(both & what & (block == p))
                for q in range(parts):
                    put(p, q, kind, at)
        turn = int(u[0]) % parts
        for w, word in enumerate(words):
            used = int(np.bitwise_or.reduce(word[~asks], initial=0))
            for b in range(BITS):
                if used >> b & 1:
                    put(w * BITS + b, turn, PASSING, np.flatnonzero(~asks & (word >> b & 1 == 1)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32()] * 3 + [pa.binary()] * 4, strict=True)], ["p", "q", "kind", "u", "i", "e", "norm"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the last user's rows so far
        for batch in batches:
            if not batch.num_rows:
                continue
            asks = batch.column("e").is_null().to_numpy(zero_copy_only=False)
            u, i, e, *words = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cut = int(np.searchsorted(u, u[-1]))
            if cut or held and held[-1][0][-1] != u[0]:
                yield from pack([*held, [c[:cut] for c in (u, i, e, asks, *words)]])
                held = []
            held.append([c[cut:] for c in (u, i, e, asks, *words)])
        if held:
            yield from pack(held)

    return send


class Block:
    """Users of a block with their ratings and requests, both by item."""

    def __init__(self, ours: list[tuple], wanted: list[tuple], k: int, absolute: bool, products: int):
        """``ours`` and ``wanted``: pieces of distinct users, their numbers of rows, packed items, residuals and norms; both lists are emptied."""
        self.k, self.absolute, self.products = k, absolute, products
        self.users, first = np.unique(np.concatenate([x[0] for x in ours]), return_index=True)
        self.norm = np.concatenate([x[4] for x in ours])[first]
        self.items, self.starts, self.who, order = self._by_item(ours)
        e = np.concatenate([x[3] for x in ours])
        ours.clear()
        self.e = e[order]
        self.wanted, self.begins, self.asks, _ = self._by_item(wanted)
        wanted.clear()
        self.active = np.zeros(len(self.users), bool)

    def _by_item(self, pieces: list[tuple]) -> tuple[np.ndarray, ...]:
        """Items, where their rows start, the rows' users as places, and the rows' order."""
        i = np.concatenate([_widened(x[2]) for x in pieces])
        items = np.unique(i)
        item = np.empty(len(i), np.int32)
        for at in range(0, len(i), BATCH):
            item[at : at + BATCH] = np.searchsorted(items, i[at : at + BATCH])
        del i
        who = np.concatenate([np.repeat(np.searchsorted(self.users, x[0]).astype(np.int32), x[1]) for x in pieces])
        order = np.lexsort((who, item))
        return items, np.concatenate([[0], np.cumsum(np.bincount(item, minlength=len(items)))]), who[order], order

    @staticmethod
    def _ranges(known: np.ndarray, starts: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known, i), len(known) - 1)
        return starts[at], np.where(known[at] == i, starts[at + 1] - starts[at], 0)

    def best(self, rows: tuple) -> Iterator[tuple]:
        """``request, v, s, e`` of at most ``k`` users for each request, of those whose ratings come as one piece; in some runs of users."""
        v, i, e, norm = rows
        run = _runs(v)
        known = v[np.flatnonzero(np.diff(run, prepend=-1))]
        first, n = self._ranges(self.items, self.starts, i)
        begin, m = self._ranges(self.wanted, self.begins, i)
        if not m.any():
            return
        # Users are gone through in runs of about so many products, those of requests with raters included.
        size = np.cumsum(np.bincount(run, n + m)) // self.products
        cuts = np.searchsorted(run, np.concatenate([[0], np.flatnonzero(np.diff(size)) + 1, [len(known)]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            x, y = expand(begin[a:b], m[a:b])
            x += a
            asks = self.asks[y]
            other = self.users[asks] != v[x]
            x, y, asks = x[other], y[other], asks[other]
            if not len(x):
                continue
            pair, which = np.unique(asks.astype(np.int64) * len(known) + run[x], return_inverse=True)
            self.active[asks] = True
            dot, met = np.zeros(len(pair)), np.zeros(len(pair), np.int64)
            # A user with more products than a run may have is met item by item.
            whole = np.cumsum(n[a:b])
            slices = np.concatenate([[0], np.flatnonzero(np.diff(whole // self.products)) + 1, [b - a]]) + a
            for c, d in zip(slices[:-1].tolist(), slices[1:].tolist(), strict=True):
                left, right = expand(first[c:d], n[c:d])
                keep = np.flatnonzero(self.active[self.who[right]])
                left, right = left[keep] + c, right[keep]
                key = self.who[right].astype(np.int64) * len(known) + run[left]
                at = np.minimum(np.searchsorted(pair, key), len(pair) - 1)
                hit = np.flatnonzero(pair[at] == key)
                at = at[hit]
                dot += np.bincount(at, self.e[right[hit]] * e[left[hit]], len(pair))
                met += np.bincount(at, minlength=len(pair))
            self.active[asks] = False
            s = dot / (self.norm[pair // len(known)] * norm[pair % len(known)] + 1e-6)
            good = np.flatnonzero(met[which] > 0)
            if len(good):
                yield self.least((y[good], v[x[good]], s[which[good]], e[x[good]]))

    def least(self, found: tuple) -> tuple:
        """The ``k`` best of each request."""
        request, v, s, _ = found
        order = np.lexsort((v, -np.abs(s) if self.absolute else -s, request))
        rank = np.arange(len(order)) - np.searchsorted(request[order], request[order])
        return tuple(c[order[rank < self.k]] for c in found)

    def named(self, found: tuple) -> Iterator[pa.RecordBatch]:
        request, v, s, e = found
        item = self.wanted[np.searchsorted(self.begins, request, side="right") - 1]
        columns = (self.users[self.asks[request]], item, v, s, e)
        for at in range(0, len(v), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + BATCH]) for c in columns], ["u", "i", "v", "s", "e"])


def finder(k: int, absolute: bool, products: int):
    """What a task makes of the pieces that it gets: ``u, i, v, s, e``, some times ``k`` rows a request at most."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours, wanted, block, held, n = [], [], None, [], 0
        for batch in batches:
            for kind, u, i, e, norm in zip(*(batch.column(c) for c in ("kind", "u", "i", "e", "norm")), strict=True):
                u = _widened(u.as_buffer())
                e, norm = (np.frombuffer(c.as_buffer(), np.float64) for c in (e, norm))
                if kind.as_py() < PASSING:
                    if block:
                        raise ValueError("pieces of a block come after those that pass by it")
                    # Copies, as the batch goes.
                    (ours if kind.as_py() == OURS else wanted).append((*np.unique(u, return_counts=True), i.as_py(), e.copy(), norm.copy()))
                    continue
                if block is None:
                    if not ours or not wanted:
                        continue
                    block = Block(ours, wanted, k, absolute, products)
                for found in block.best((u, _widened(i.as_buffer()), e, norm)):
                    held.append(found)
                    n += len(found[0])
                    if n > FOUND:
                        held = [block.least(tuple(np.concatenate(c) for c in zip(*held, strict=True)))]
                        n = len(held[0][0])
                        if n > FOUND // 2:
                            yield from block.named(held[0])
                            held, n = [], 0
        if held:
            yield from block.named(block.least(tuple(np.concatenate(c) for c in zip(*held, strict=True))))

    return best
