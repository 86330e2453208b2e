"""Allow and block rules for urls, decided by Bloom filter cascades.

A rule is a host and a path prefix; it fits the host, its subdomains, and every path that starts with
the prefix. A url's candidate keys are its host's suffixes (at dots) with its path's prefixes, of the numbers of labels and the
lengths that rules have; no other key can be a rule. The corpus's key universe is the set of all its candidate keys.

For each list (block, allow) a cascade gives exact membership over that universe. Level 1 is a Bloom
filter of the listed keys, level 2 of the universe's keys that pass level 1 though they aren't listed, level 3 of the
listed keys that pass level 2, and so on until nothing passes wrongly. A key is listed when the
first level that rejects it is even, or none rejects it and the number of levels is odd. Judging
urls then takes no join: the filters are literals in the plan, at most ``MAX_BITS`` each. A list that needs more is parted by the keys'
hash, each part with a cascade of its own; urls go through one part after the other, so a plan holds one. Only built-in functions are used.

Special cases: a null url or one without ``://`` has an empty host and path, fits no rule and gets
the verdict for unlisted keys; urls, hosts and paths of any length are judged (keys are as many as rules have shapes); repeated urls are judged alike; of two fitting rules of one length
the one with the longer host wins; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.stage import literal_rows, stage

#: Bits of a filter at most, and words that come to the driver in a row.
MAX_BITS, PACKED = 1 << 26, 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    bits: int
    hashes: int
    number: int

    def passes(self, key: Column) -> Column:
        words = F.lit(np.array(self.words, dtype=np.int64))
        result = F.lit(True)
        for p in _positions(key, self):
            result = result & (F.getbit(F.element_at(words, F.shiftright(p, 6).cast("int") + 1), (p % 64).cast("int")) == 1)
        return result


def _positions(key: Column, level: Level) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level.number * 64 + i)), F.lit(level.bits).cast("long")) for i in range(level.hashes)]


def _bits(n: int, rate: float) -> int:
    return max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))


def _level(keys: DataFrame, n: int, rate: float, number: int) -> Level:
    bits = _bits(n, rate)
    plan = Level((), bits, max(1, round(bits / n * math.log(2))) if n * 20 > bits else 14, number)
    word, one = F.shiftright("p", 6).cast("int"), F.expr("shiftleft(1L, cast(p % 64 as int))")
    ones = keys.select(F.explode(F.array(*_positions(F.col("key"), plan))).alias("p")).groupBy(word.alias("word")).agg(F.bit_or(one).alias("bits"))
    # A thousand words a row.
    packed = ones.groupBy(F.floor(F.col("word") / PACKED).alias("row")).agg(F.map_from_entries(F.collect_list(F.struct(F.pmod("word", F.lit(PACKED)).alias("k"), "bits"))).alias("m"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(PACKED - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)))
    words = [0] * (-(-(bits // 64 + 1) // PACKED) * PACKED)
    for row, values in packed.select("row", whole.alias("values")).collect():  # at most MAX_BITS / 64 / PACKED rows
        words[row * PACKED : (row + 1) * PACKED] = values
    return Level(tuple(words[: bits // 64 + 1]), bits, plan.hashes, number)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        result = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            result = F.when(self.levels[i].passes(key), result).otherwise(F.lit(i % 2 == 1))
        return result


def _rate(listed: int, unlisted: int) -> float:
    """Of wrong passes at level 1; the later ones halve what is left."""
    return max(min(0.5, max(listed, 1) / max(2 * unlisted, 1)), 1e-6)


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts))


def parts_for(listed: DataFrame, universe: DataFrame) -> int:
    """Cascades that a list is parted into, so that no filter is over MAX_BITS (by four fifths, as parts differ in size)."""
    n = listed.count()
    return max(1, math.ceil(_bits(n, _rate(n, universe.count())) / (0.8 * MAX_BITS))) if n else 1


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade that is exact for every ``key`` of ``listed`` and of ``universe`` (distinct keys)."""
    unlisted = universe.join(listed, "key", "left_anti")
    sets, levels, n = [listed, unlisted], [], listed.count()
    rate = _rate(n, unlisted.count())
    while n:
        at = len(levels)
        levels.append(_level(sets[at % 2], n, rate if at == 0 else 0.5, at))
        other = (at + 1) % 2
        sets[other] = sets[other].where(levels[-1].passes(F.col("key")))
        n = sets[other].count()
    return Cascade(tuple(levels))


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "#", 1)).otherwise("")
    after = F.coalesce(F.substring_index(after, "?", 1), F.lit(""))
    cut = F.instr(after, "/")
    host = F.when(cut > 0, F.substring(after, F.lit(1), cut - 1)).otherwise(after)
    path = F.when(cut > 0, F.substring(after, cut, F.length(after))).otherwise("")
    return F.translate(host, _UPPER, _LOWER), path


def candidates(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Array of (length of key, length of host, key) for each host suffix and path prefix of the given numbers of labels and lengths."""
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    suffixes = F.filter(F.array(*[F.when(dots >= n - 1, F.substring_index(host, ".", -n)) for n in labels]), lambda s: s.isNotNull() & (s != ""))
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda n: _key(s, F.substring(path, F.lit(1), n)))))


def _key(host: Column, prefix: Column) -> Column:
    key = F.concat(host, prefix)
    return F.struct(F.length(key).alias("length"), F.length(host).alias("host"), key.alias("key"))


def judge_urls(pages: DataFrame, rules: list[Rule], unlisted: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` (the longest that fits, else null) and ``verdict`` of each row."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    found = pages.select(F.col(key).alias("id"), host.alias("host"), path.alias("path"))
    lengths, labels = sorted({len(r.path) for r in rules}), sorted({r.host.count(".") + 1 for r in rules})
    own = candidates(F.col("host"), F.col("path"), labels, lengths)
    universe = stage(found.select("host", "path").select(F.explode(own).alias("c")).select("c.key").distinct())
    kind = "struct<length: int, h: int, rule: string, verdict: string>"
    judged = found.withColumn("best", F.lit(None).cast(kind))
    for verdict in sorted({r.verdict for r in rules}):
        listed = literal_rows(spark, [(k,) for k in sorted({r.key for r in rules if r.verdict == verdict})], [("key", "string")])
        parts = parts_for(listed, universe)
        for part in range(parts):
            here = F.lit(True) if parts == 1 else part_of(F.col("key"), parts) == part
            cascade = build_cascade(listed.where(here), universe.where(here))
            inside = lambda c: cascade.contains(c["key"]) if parts == 1 else (part_of(c["key"], parts) == part) & cascade.contains(c["key"])  # noqa: B023, E731
            best = F.array_max(F.filter(own, inside))
            fits = F.when(best.isNotNull(), F.struct(best["length"].alias("length"), best["host"].alias("h"), best["key"].alias("rule"), F.lit(verdict).alias("verdict")).cast(kind))
            judged = judged.withColumn("best", F.greatest("best", fits))  # nulls are passed over
            if parts > 1:
                judged = stage(judged)  # the next part's plan holds its own filters only
    return judged.select(F.col("id").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(unlisted)).alias("verdict"))
