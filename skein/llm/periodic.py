"""Runs of words that repeat with a period, and texts with each run cut down to its first period.

A run is a stretch of consecutive words with smallest period ``q`` and at least ``max(least, repeats * q)`` words that can't be extended. Its words equal the
word ``q`` later in a stretch of at least ``need = max(least, repeats * q) - q`` places, so only lags with that many matches are looked at. Matches of all lags up
to a ``repeats``-th of the text are counted exactly: words that are frequent in their text (over ``sqrt(n log2 n)`` of ``n``) by the autocorrelation of their places, with one
fast Fourier transform a word and one back for their sum, rounded to the whole numbers that it stands for; rare words by the differences of their places.
Lags with enough matches get island scans, shortest first. A run found at ``q`` accounts for its matches at all multiples of ``q``, which are taken off before those come
up: whatever stretch holds them has period ``q`` too. Long lags look at every ``q / 8``-th place first, and compare all words only
where enough of these match in turn, so the scans of a text of ``n`` words cost ``n log n`` comparisons besides those of its runs and near runs.

Each text is worked on where it is read, in batches of texts whose words are numbered apart; nothing is shuffled. Very long texts are read in pieces and stay
in memory as numbers.

Special cases: null and empty texts, and texts of blanks, have no words, no runs and an empty collapsed text; words are split at the ASCII blanks only; overlapping runs are all
returned; a word is dropped if any run says so; equal runs can't tie, as start and length determine the smallest period; repeated rows and
null ids are rows like others; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.batches import slices, texts_of

#: Words of a run at least, and periods in it at least.
LEAST, REPEATS = 6, 4
WORD = "[^\\x20\\x09-\\x0D]+"
#: Characters whose words are held as strings at once; differences counted at once; places looked at in a period.
PIECE, PENDING, LOOKS = 1 << 20, 1 << 20, 8

_word, _blank = re.compile(WORD), re.compile("[\\x20\\x09-\\x0D]")


def number_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """All words as numbers, of which no two texts share one; where each text begins; the words by number."""
    words, parts, bounds = [], [np.zeros(0, np.int64)], [0]
    for text in texts:
        known = defaultdict(count(len(words)).__next__)
        at = n = 0
        while at < len(text):
            cut = _blank.search(text, at + PIECE)
            end = cut.start() if cut else len(text)
            found = _word.findall(text, at, end)
            parts.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
            n, at = n + len(found), end
        words.extend(known)
        bounds.append(bounds[-1] + n)
    return np.concatenate(parts), np.array(bounds), words


def lag_matches(words: np.ndarray, bounds: np.ndarray, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """``counts, at``: ``counts[at[d] + q]`` places of text ``d`` equal the place ``q`` later, for ``q`` up to a ``repeats``-th of its words."""
    sizes = np.diff(bounds)
    lags = sizes // repeats
    at = np.concatenate([[0], np.cumsum(lags + 1)])
    counts = np.zeros(at[-1], np.int64)
    if not len(words):
        return counts, at
    order = np.argsort(words, kind="stable")
    first = np.flatnonzero(np.diff(words[order], prepend=-1))
    often = np.diff(first, append=len(order))
    text = np.searchsorted(bounds, order[first], "right") - 1
    heavy = often > np.sqrt(sizes[text] * np.log2(sizes[text] + 1))
    for d in np.unique(text[heavy]):
        n = 1 << int(sizes[d] + lags[d]).bit_length()  # room for all lags without wrapping round
        power = np.zeros(n // 2 + 1)
        for k in np.flatnonzero(heavy & (text == d)):
            here = np.zeros(sizes[d])
            here[order[first[k] : first[k] + often[k]] - bounds[d]] = 1
            spectrum = np.fft.rfft(here, n)
            power += spectrum.real**2 + spectrum.imag**2
        counts[at[d] : at[d + 1]] += np.rint(np.fft.irfft(power, n)[: lags[d] + 1]).astype(np.int64)
    light = np.repeat(~heavy, often)
    places, base, most = order[light], np.repeat(at[text], often)[light], np.repeat(lags[text], often)[light]
    word = words[places]
    left, held, pending, k = np.arange(len(places)), [], 0, 0
    while len(left):
        k += 1
        left = left[: np.searchsorted(left, len(places) - k)]
        left = left[word[left + k] == word[left]]
        apart = places[left + k] - places[left]
        near = apart <= most[left]
        left = left[near]  # the next of the same word are further off
        held.append(base[left] + apart[near])
        pending += len(left)
        if pending > PENDING or not len(left):
            found, n = np.unique(np.concatenate(held), return_counts=True)
            counts[found] += n
            held, pending = [], 0
    return counts, at


def stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the maximal stretches of at least ``least`` true values start and end."""
    edges = np.flatnonzero(np.diff(same.view(np.int8), prepend=0, append=0))
    start, end = edges[::2], edges[1::2]
    long = end - start >= least
    return start[long], end[long]


def islands(words: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """Where the maximal stretches of ``least`` or more words that equal the word ``q`` later start and end."""
    n, step = len(words) - q, max(1, q // LOOKS)
    windows = [(0, n)]
    if step > 1:
        start, end = stretches(words[:n:step] == words[q::step], least // step)
        windows = [(max(0, (s - 1) * step + 1), min(n, e * step)) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
    out = []
    for low, high in windows:
        start, end = stretches(words[low:high] == words[low + q : high + q], least)
        out += zip((start + low).tolist(), (end + low).tolist(), strict=True)
    return out


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[list[tuple[int, int, int]]]:
    """Start, length and period of the runs of each text, by start, then period."""
    counts, at = lag_matches(words, bounds, repeats)
    runs: list[dict[tuple[int, int], int]] = [{} for _ in bounds[1:]]
    lag = np.arange(len(counts)) - np.repeat(at[:-1], np.diff(at))
    enough = np.flatnonzero((lag > 0) & (counts >= np.maximum(least - lag, (repeats - 1) * lag)))
    enough = enough[np.argsort(lag[enough], kind="stable")]
    texts = np.searchsorted(at, enough, "right") - 1
    cuts = np.flatnonzero(np.diff(lag[enough], prepend=-1, append=-1)) if len(enough) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        q = int(lag[enough[a]])
        need = max(least - q, (repeats - 1) * q)
        left = texts[a:b][counts[enough[a:b]] >= need]  # the rest was accounted for by shorter periods
        if not len(left):
            continue
        part = np.concatenate([words[bounds[d] : bounds[d + 1]] for d in left])
        begin = np.concatenate([[0], np.cumsum(bounds[left + 1] - bounds[left])])
        for start, end in islands(part, q, need):  # none goes across texts, as their words differ
            k = int(np.searchsorted(begin, start, "right")) - 1
            d, start, length = left[k], int(start - begin[k]), int(end - start + q)
            if (start, length) not in runs[d]:
                runs[d][start, length] = q
                more = np.arange(2 * q, min(length, at[d + 1] - at[d]), q)
                counts[at[d] + more] -= length - more
    return [sorted((s, n, q) for (s, n), q in of.items()) for of in runs]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words no run contains after its first period."""
    inside = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        inside[start + period] += 1
        inside[start + length] -= 1
    return np.cumsum(inside[:n]) == 0


def periodic_runs(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words``, ``runs`` (start, length and period of each, by start, then period) and ``collapsed`` (the words that stay, joined by blanks)."""
    run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    schema = T.StructType([docs.schema[key], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, bounds, names = number_words(texts_of(batch, text))
            runs = find_runs(words, bounds, least, repeats)
            kept = [own[kept_words(len(own), r)] if r else own for own, r in zip(np.split(words, bounds[1:-1]), runs, strict=True)] if batch.num_rows else []
            flat = np.array([r for of in runs for r in of], np.int64).reshape(-1, 3)
            ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c) for c in flat.T], names=run.names))
            collapsed = pa.array([" ".join(map(names.__getitem__, k.tolist())) for k in kept], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.diff(bounds)), listed, collapsed], names=schema.names)

    return docs.select(key, text).mapInArrow(find, schema)


def longest(runs: str = "runs") -> Column:
    """The run of greatest length; of several the one with the smallest start, then period; null without a run."""
    before = F.array_sort(runs, lambda a, b: F.when(a["length"] != b["length"], F.signum(b["length"] - a["length"])).when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"])).cast("int"))
    return F.get(before, F.lit(0))


def run_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of runs, the longest one and its exponent, and hashes of all runs and of the collapsed text, from :func:`periodic_runs`."""
    best = longest()
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def plant_period(key: str = "doc_id", text: str = "text") -> Column:
    """Text in which, for one id in ten, the words from some word on repeat with some period, both drawn from the id's hash; others stay as they are."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.expr(f"crc32(cast(cast({key} as string) as binary)) div 10")

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # The list of words is an argument of the inner function, so that it is made once for a text and not once for a word.
    lists = F.filter(F.array(F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1))), lambda words: F.size(words) > 0)
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)), F.coalesce(F.get(F.transform(lists, repeated), F.lit(0)), F.lit(""))).otherwise(F.col(text))
