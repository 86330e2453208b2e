"""Token counts from an exact histogram of encoded lengths.

Every text is encoded whole and counted; documents are aggregated by length, which partial aggregation
does before the shuffle. Runs of whitespace that the pattern's matcher couldn't hold are cut out where
the pattern itself cuts and counted as the one piece they are, so texts of any content are counted. Suffix sums over the histogram then answer, for each context limit at once,
how many documents reach it, how many tokens lie in longer ones, and the tokens left if every document
is cut there. They are computed in two steps, within blocks of lengths and over block totals, so that no task
sees more than one block of the histogram.

Special cases: null and empty texts have length 0; texts of any length, also of one unbroken run, are counted whole; repeated rows count each time; an empty table
gives an empty histogram; ties don't arise, as a length is one row; other columns aren't read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.llm.batches import map_texts
from skein.stage import stage

#: Lengths in a block of the two-step suffix sums.
BLOCK = 1024
#: Whitespace (the Unicode property, which the pattern's ``\\s`` stands for) that is counted apart, from this many characters on.
LONG_RUN = 1000

_long_run = re.compile(f"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_RUN},}}").finditer


def _encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def counter(encoding) -> Callable[[str], int]:
    """Number of tokens of a text, for patterns that read a run of whitespace as ``\\s+(?!\\S)|\\s+``.

    Such a pattern takes a run as one piece, less its last character if something follows, and backtracks over each of its
    characters on the way. Long runs are counted as that piece, and what stands between them is encoded as it is.
    """
    encode, piece = encoding.encode_ordinary, encoding._encode_single_piece

    def count(text: str) -> int:
        total = at = 0
        for run in _long_run(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            total += len(encode(text[at : run.start()])) + len(piece(text[run.start() : end]))
            at = end
        return total + len(encode(text[at:]))

    return count


def token_lengths(docs: DataFrame, ranks_path: str, pattern: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys`` and ``n_tokens`` (no special tokens) of each row."""

    def make():
        count = counter(_encoding(ranks_path, pattern))
        return lambda texts: [list(map(count, texts))]

    return map_texts(docs, list(keys), [("n_tokens", T.LongType(), pa.int64())], make, text)


def length_histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """One row for each length L that occurs.

    ``n_docs``: documents of that length; ``docs_ge``, ``tokens_ge``: documents and tokens of length L or more;
    ``docs_le``: of length L or less, so the q-quantile is the smallest L with ``docs_le >= q * docs``;
    ``docs``, ``tokens``: the totals; ``tokens_cut``: tokens left when each document is cut to L.
    """
    hist = lengths.groupBy(F.col(length).alias("length")).agg(F.count("*").alias("n_docs"))
    hist = stage(hist.withColumn("block", F.expr(f"length div {BLOCK}")))  # read twice below
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = (
        hist.groupBy("block")
        .agg(F.sum("n_docs").alias("bd"), F.sum(F.col("n_docs") * F.col("length")).alias("bt"))
        .select(
            "block",
            F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("docs_after"),
            F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("tokens_after"),
            F.sum("bd").over(whole).alias("docs"),
            F.sum("bt").over(whole).alias("tokens"),
        )
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length"))
    out = hist.join(blocks, "block")
    docs_ge = F.col("docs_after") + F.sum("n_docs").over(inside)
    tokens_ge = F.col("tokens_after") + F.sum(F.col("n_docs") * F.col("length")).over(inside)
    out = out.select("length", "n_docs", docs_ge.alias("docs_ge"), tokens_ge.alias("tokens_ge"), "docs", "tokens")
    return out.select(
        "*",
        (F.col("docs") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"),
        (F.col("tokens") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")).alias("tokens_cut"),
    )


def quantiles(histogram: DataFrame, qs: list[float]) -> DataFrame:
    """``q`` and ``length``: for each q the smallest length that at least q of all documents don't exceed."""
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in qs]))
    reached = histogram.select("length", "docs", "docs_le", wanted.alias("q")).where(F.col("docs_le") >= F.col("q") * F.col("docs"))
    return reached.groupBy("q").agg(F.min("length").alias("length"))


def totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``limit`` and ``tokens_cut``: tokens left when each document is cut to that limit, whether or not the length occurs."""
    wanted = F.explode(F.array(*[F.lit(int(n)).cast("long") for n in limits]))
    return (
        histogram.select("length", "n_docs", wanted.alias("limit"))
        .groupBy("limit")
        .agg(F.sum(F.least("length", "limit") * F.col("n_docs")).alias("tokens_cut"))
    )
