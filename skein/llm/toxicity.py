"""Toxicity scores from a bidirectional gated recurrent network.

A text is lower-cased and read as words, in overlapping windows of ``WINDOW`` words, ``STEP`` apart, that
cover all of it. A word's input is the sum of a word vector (hashed) and the mean of its character
trigrams' vectors (hashed), so that unseen forms of a known stem are recognised. Gated recurrent
units read each window in both directions, attention pools their states, and a logistic output
scores it. A document's score is its highest window's, calibrated on sampled documents kept from training.

Training, in numpy on the driver, takes a bounded sample: at most ``PER_CLASS`` labelled documents of each
class with at most ``LONGEST`` words and ``LONGEST_BYTES`` bytes, and a fixed number of batches. Labels are of documents, not
windows: first every window has its document's label, then toxic documents are stood for by their
highest windows and the others by their highest and by random ones. Scoring reads every document once, with
no shuffle; words' input gates are computed once for each distinct word of a worker's bounded table.

Special cases: a null or empty text is one empty window; texts of any length are scored whole; repeated
rows get equal scores (to five digits); without labelled rows of both classes every score is the share of label 1
(0 if there are none); an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.batches import fold, keep_rows, map_texts
from skein.llm.labelled import labelled_sample

PER_CLASS, LONGEST, LONGEST_BYTES = 1500, 1500, 24_000
THRESHOLD = 0.3
WINDOW, STEP = 32, 24
WORD_ROWS, CHAR_ROWS, WIDTH, HIDDEN, ATTEND = 8192, 8192, 12, 8, 8
BATCH, FIRST_UPDATES, LATER_UPDATES, RATE = 256, 240, 360, 0.01
#: Of a vector table's largest squared gradient, what its step size is divided by.
TABLE_SHARE = 0.2
#: Pull of the vector tables to zero, and the share of words left out of a training window: against learning rare words by heart.
DECAY, LEFT_OUT = 0.6, 0.25
#: Share of the sampled documents that are kept from training and calibrate the scores.
CALIBRATE = 0.2
TABLE_WORDS = 300_000
#: Windows that go through the network together.
AT_ONCE = 8192

_words = re.compile(r"\w+").findall


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def windows_of(ids: np.ndarray, counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids cut into windows (padded with -1), and the text that each window belongs to."""
    per = [1 + max(0, -(-(n - WINDOW) // STEP)) for n in counts]
    owner = np.repeat(np.arange(len(counts)), per)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    start = first[owner] + inside * STEP
    at = start[:, None] + np.arange(WINDOW)
    end = (first + np.array(counts, dtype=np.int64))[owner][:, None]
    padded = np.append(ids, -1)
    return np.where(at < end, padded[np.minimum(at, len(ids))], -1), owner


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word's vector, rows of all its trigrams' vectors, and where each word's trigrams start."""
    rows = np.fromiter((zlib.crc32(w.encode()) % WORD_ROWS for w in words), np.int64, len(words))
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    tri = (codes[:-2] * 40503 + codes[1:-1] * 2654435 + codes[2:] * 97) % CHAR_ROWS
    ends = np.cumsum(sizes)
    inside = np.ones(len(codes), bool)
    inside[ends - 1] = False
    inside[ends - 2] = False
    starts = np.concatenate([[0], np.cumsum(sizes - 2)])[:-1]
    return rows, tri[inside[:-2]], starts


@dataclass
class Net:
    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    cache: dict = field(default_factory=dict)

    @staticmethod
    def new(seed: int = 5) -> Net:
        rng = np.random.default_rng(seed)
        shapes = {"word": (WORD_ROWS, WIDTH), "char": (CHAR_ROWS, WIDTH), "att": (2 * HIDDEN, ATTEND), "att_v": (ATTEND,), "out": (2 * HIDDEN,), "out_b": (1,)}
        for d in "fb":
            shapes |= {f"in_{d}": (WIDTH, 3 * HIDDEN), f"bias_{d}": (3 * HIDDEN,), f"rec_{d}": (HIDDEN, 3 * HIDDEN)}
        small = {"bias_f", "bias_b", "out_b"}
        return Net({k: (np.zeros(s) if k in small else rng.normal(0, 0.1 if k in ("word", "char") else s[0] ** -0.5, s)).astype(np.float32) for k, s in shapes.items()})

    def word_vectors(self, features: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        rows, tri, starts = features
        counts = np.diff(np.append(starts, len(tri)))[:, None].astype(np.float32)
        return self.p["word"][rows] + np.add.reduceat(self.p["char"][tri], starts, axis=0) / counts

    def gates(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        """Input part of the gates for each word, with the padding's (a zero vector) last."""
        padded = np.concatenate([vectors, np.zeros((1, WIDTH), np.float32)])
        return {d: padded @ self.p[f"in_{d}"] + self.p[f"bias_{d}"] for d in "fb"}

    def forward(self, windows: np.ndarray, gates: dict[str, np.ndarray], keep: dict | None = None) -> np.ndarray:
        """Logit of each window. ``keep`` receives what the backward pass needs."""
        n, length, h = len(windows), windows.shape[1], HIDDEN
        states = np.empty((length, n, 2 * h), np.float32)
        for d, order in (("f", range(length)), ("b", range(length - 1, -1, -1))):
            state = np.zeros((n, h), np.float32)
            table, rec = gates[d], self.p[f"rec_{d}"]
            for t in order:
                g, r = table[windows[:, t]], state @ rec
                rz = _sigmoid(g[:, : 2 * h] + r[:, : 2 * h])
                new = np.tanh(g[:, 2 * h :] + rz[:, :h] * r[:, 2 * h :])
                before = state
                state = new + rz[:, h:] * (state - new)
                states[t, :, slice(0, h) if d == "f" else slice(h, None)] = state
                if keep is not None:
                    keep[d, t] = (rz, new, before, r[:, 2 * h :])
        hidden = np.tanh(states @ self.p["att"])
        score = hidden @ self.p["att_v"]
        score[windows.T < 0] = -30
        score -= score.max(axis=0)
        np.exp(score, out=score)
        score /= score.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", score, states)
        if keep is not None:
            keep |= {"states": states, "hidden": hidden, "alpha": score, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["out_b"][0]

    def gradients(self, windows: np.ndarray, features, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss. ``windows`` index the words that ``features`` describe."""
        p, h, keep = self.p, HIDDEN, {}
        vectors = self.word_vectors(features)
        logit = self.forward(windows, self.gates(vectors), keep)
        out = {k: np.zeros_like(v) for k, v in p.items()}
        d_logit = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
        states, hidden, alpha = keep["states"], keep["hidden"], keep["alpha"]
        out["out"], out["out_b"] = d_logit @ keep["pooled"], d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["out"]
        d_states = alpha[:, :, None] * d_pooled
        d_alpha = np.einsum("nh,tnh->tn", d_pooled, states)
        d_score = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        d_hidden = d_score[:, :, None] * p["att_v"] * (1 - hidden**2)
        out["att_v"] = np.einsum("tn,tna->a", d_score, hidden)
        out["att"] = np.einsum("tnh,tna->ha", states, d_hidden)
        d_states += d_hidden @ p["att"].T
        flat = windows.T.ravel()
        order = np.argsort(flat, kind="stable")
        order = order[np.searchsorted(flat[order], 0) :]  # without padding
        used, begin = np.unique(flat[order], return_index=True)
        d_vectors = np.zeros_like(vectors)
        for d, steps in (("f", range(windows.shape[1] - 1, -1, -1)), ("b", range(windows.shape[1]))):
            d_gates = np.zeros((windows.shape[1], len(windows), 3 * h), np.float32)
            carry = np.zeros((len(windows), h), np.float32)
            for t in steps:
                rz, new, before, r_new = keep[d, t]
                r, z = rz[:, :h], rz[:, h:]
                d_h = carry + d_states[t, :, slice(0, h) if d == "f" else slice(h, None)]
                d_n = d_h * (1 - z) * (1 - new**2)
                d_z = d_h * (before - new) * z * (1 - z)
                d_r = d_n * r_new * r * (1 - r)
                d_rec = np.concatenate([d_r, d_z, d_n * r], axis=1)
                d_gates[t] = np.concatenate([d_r, d_z, d_n], axis=1)
                out[f"rec_{d}"] += before.T @ d_rec
                carry = d_h * z + d_rec @ p[f"rec_{d}"].T
            every = d_gates.reshape(-1, 3 * h)
            out[f"bias_{d}"] = every.sum(axis=0)
            by_word = np.zeros((len(vectors), 3 * h), np.float32)
            by_word[used] = np.add.reduceat(every[order], begin, axis=0)
            out[f"in_{d}"] = vectors.T @ by_word
            d_vectors += by_word @ p[f"in_{d}"].T
        rows, tri, starts = features
        np.add.at(out["word"], rows, d_vectors)
        counts = np.diff(np.append(starts, len(tri)))
        np.add.at(out["char"], tri, np.repeat(d_vectors / counts[:, None], counts, axis=0))
        return out

    def logits(self, texts: list[str]) -> np.ndarray:
        """Each text's highest window."""
        c = self.cache
        if len(c.get("ids", ())) > TABLE_WORDS or not c:
            c |= {"ids": {}, "vectors": np.zeros((0, WIDTH), np.float32)}
        known, vectors = c["ids"], c["vectors"]
        split = [_words(t.lower()) for t in texts]
        flat = [w for s in split for w in s]
        new = [w for w in dict.fromkeys(flat) if w not in known]
        if new:
            known |= zip(new, range(len(known), len(known) + len(new)), strict=True)
            vectors = c["vectors"] = np.concatenate([vectors, self.word_vectors(word_features(new))])
            c["gates"] = None
        if c.get("gates") is None:
            c["gates"] = self.gates(vectors)
        ids = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        windows, owner = windows_of(ids, [len(s) for s in split])
        scores = np.concatenate([self.forward(windows[i : i + AT_ONCE], c["gates"]) for i in range(0, len(windows), AT_ONCE)] or [np.zeros(0)])
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, owner, scores)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        # Rounded, as single-precision sums differ in their last digits with a batch's size.
        return np.round(1 / (1 + np.exp(-(self.scale * self.logits(texts) + self.shift))), 6)


class Adam:
    """Adam; the vector tables share one step size each, so that rare words, whose gradients are small, move little."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.t = 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        for k, x in p.items():
            self.m[k] += 0.1 * (g[k] - self.m[k])
            square = g[k] ** 2
            self.v[k] += 0.01 * ((square.max() * TABLE_SHARE if k in ("word", "char") else square) - self.v[k])
            if k in ("word", "char"):
                x *= 1 - rate * DECAY
            x -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6)


def fit(texts: list[str], y: np.ndarray, share: float, seed: int = 7) -> Net:
    """A network fitted to documents' labels; ``share``: of label 1 among all labelled documents."""
    net = Net.new()
    if not 0 < y.sum() < len(y):
        net.constant = float(share)
        return net
    rng = np.random.default_rng(seed)
    split = [_words(t.lower()) for t in texts]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for s in split for w in s))}
    rows, tri, starts = word_features(list(vocabulary))
    sizes = np.diff(np.append(starts, len(tri)))
    windows, owner = windows_of(np.array([vocabulary[w] for s in split for w in s], np.int64), [len(s) for s in split])
    toxic = y[owner] == 1
    apart = np.zeros(len(y), bool)  # documents that only calibrate the scores
    for c in (0, 1):
        apart[rng.permutation(np.flatnonzero(y == c))[: int((y == c).sum() * CALIBRATE)]] = True
    seen = ~apart[owner]
    toxic_at, clean_at = np.flatnonzero(toxic & seen), np.flatnonzero(~toxic & seen)
    adam = Adam(net.p)

    def update(positive: np.ndarray, negative: np.ndarray, rate: float) -> None:
        half = BATCH // 2
        some = np.concatenate([rng.choice(positive, half), rng.choice(negative, half)])
        used, local = np.unique(np.where(rng.random((BATCH, WINDOW)) < LEFT_OUT, -1, windows[some]), return_inverse=True)
        local = local.reshape(len(some), WINDOW) - (used[0] < 0)
        used = used[used >= 0]
        n = sizes[used]
        at = np.repeat(starts[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        adam.step(net.p, net.gradients(local, (rows[used], tri[at], np.cumsum(n) - n), toxic[some].astype(np.float32)), rate)

    def highest() -> tuple[np.ndarray, np.ndarray]:
        gates = net.gates(net.word_vectors((rows, tri, starts)))
        logit = np.concatenate([net.forward(windows[i : i + AT_ONCE], gates) for i in range(0, len(windows), AT_ONCE)])
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, logit)
        return logit, best

    for _ in range(FIRST_UPDATES):
        update(toxic_at, clean_at, RATE)
    for i in range(LATER_UPDATES):
        if i % 60 == 0:
            logit, best = highest()
            top = logit >= best[owner]
            hard = clean_at[top[clean_at]]
        clean = np.concatenate([hard, rng.choice(clean_at, len(hard))])
        update(toxic_at[top[toxic_at]], clean, RATE * (1 - i / LATER_UPDATES) + 1e-3)
    _, best = highest()
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    on = apart if 0 < y[apart].sum() < apart.sum() else ~apart
    net.scale, net.shift = _calibrate(best[on], y[on], weight[on])
    return net


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a weighted logistic regression with a weak prior at scale 1."""
    a, b = 1.0, 0.0
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, s = weight * (q - y), weight * q * (1 - q)
        grad = np.array([(r * x).sum() + (a - 1), r.sum()])
        hess = np.array([[(s * x * x).sum() + 1, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - step[0], b - step[1]
    return float(max(a, 0.05)), float(b)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, held_out: tuple[int, int] | None = (4, 2)) -> Net:
    """A network fitted to ``labels.toxic``, of rows outside the held-out fold (parts, remainder)."""
    usable = fold("doc_id", held_out[0]) != held_out[1] if held_out else F.lit(True)
    held = F.coalesce("text", F.lit(""))
    short = docs.where((F.octet_length(held) <= LONGEST_BYTES) & (F.regexp_count(held, F.lit(r"\s+")) < LONGEST))
    sample, counts = labelled_sample(short, labels, "toxic", usable, per_class)
    rows = sorted(sample.collect(), key=lambda r: r["doc_id"])  # at most 2 * per_class texts of LONGEST words and LONGEST_BYTES
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit([r["text"] or "" for r in rows], np.array([r["label"] for r in rows], float), share)


def score_documents(docs: DataFrame, net: Net, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, ``score`` (0 to 1, higher: label 1 likelier) of each row."""
    return map_texts(docs, list(keys), [("score", T.DoubleType(), pa.float64())], lambda: lambda texts: [net.score(texts)])


def keep_clean(docs: DataFrame, net: Net, threshold: float = THRESHOLD) -> DataFrame:
    """The rows scored below ``threshold``, with all their columns."""
    return keep_rows(docs, lambda: lambda texts: net.score(texts) < threshold)
