"""URL filters by a Bloom filter cascade.

The keys that can be asked for are all known: every suffix of every host in the corpus.  Level 1 holds the listed
keys; level 2 holds those unlisted keys that level 1 lets through; level 3 the listed keys that level 2 lets
through; and so on until no key is left.  A key is listed exactly if the number of levels that it passes before
one turns it away is odd.  The levels are literals in the plan, so pages are judged in the scan, without a join.
DataFrame functions only.

Defined results.  A url that is null or has no ``://`` has an empty host and path, fits no rule and is allowed.
Hosts are compared as written but for A-Z; ports and user names are part of them.  Null listed keys are ignored,
repeated ones count once.  Hosts and paths may be of any length.  Of rules of equal length that fit, the last by host,
path and verdict decides.  Repeated rows each get their verdict.  An empty list allows all, an empty table gives no
rows.  Columns host, path, rule and verdict are set anew, all others pass through.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import Tables, ascii_lower

#: Bits a key and hash functions of the first level, and of the later ones.
FIRST, LATER = (10, 5), (5, 3)
#: A cascade of more listed keys than this is built and asked in blocks of about this many.
BLOCK_KEYS = 4_000_000


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """a.b.c to [a.b.c, b.c, c]; an empty host has none."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    all_of = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(all_of)


@dataclass
class Level:
    bits: bytes
    m: int
    k: int
    number: int

    def positions(self, key: Column) -> list[Column]:
        return bit_positions(key, self.number, self.m, self.k)

    def passes(self, key: Column) -> Column:
        out = None
        for p in self.positions(key):
            byte = F.conv(F.hex(F.substring(F.lit(self.bits), (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            hit = F.expr("1").bitwiseAND(F.call_function("shiftright", byte, (p % 8).cast("int"))) == 1
            out = hit if out is None else out & hit
        return out


def bit_positions(key: Column, number: int, m: int, k: int) -> list[Column]:
    """k positions below m, by two hashes that the level's number makes its own."""
    a, b = F.xxhash64(key, F.lit(number)), F.xxhash64(F.lit(number), key)
    return [F.pmod(F.shiftrightunsigned(a, 8) + F.lit(i) * F.shiftrightunsigned(b, 8), F.lit(m).cast("long")) for i in range(k)]


class Cascade:
    """Exact membership in a list, over a known universe of keys."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, spark: SparkSession, listed: DataFrame, universe: DataFrame) -> Cascade:
        """``listed`` and ``universe``: DataFrames of one column ``key`` without nulls or repeats."""
        tables = Tables(spark)
        ins = tables.cut(universe.join(listed, "key", "left_semi"), "cascade-in")
        outs = tables.cut(universe.join(listed, "key", "left_anti"), "cascade-out")
        levels: list[Level] = []
        while n := ins.count():
            level = cls._level(ins, n, len(levels) + 1, *(LATER if levels else FIRST))
            levels.append(level)
            through = tables.cut(outs.filter(level.passes(F.col("key"))), "cascade-through")
            tables.drop(outs)
            ins, outs = through, ins  # the next level holds what came through wrongly
        tables.drop(ins)
        tables.drop(outs)
        return cls(levels)

    @staticmethod
    def _level(keys: DataFrame, n: int, number: int, per_key: int, k: int) -> Level:
        m = max(64, (n * per_key + 63) // 64 * 64)
        at = keys.select(F.explode(F.array(*bit_positions(F.col("key"), number, m, k))).alias("p"))
        words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("x"))
        bits = np.zeros(m // 64, dtype="<i8")
        for w, x in words.toLocalIterator():  # m / 64 rows at most
            bits[w] = x
        return Level(bits.tobytes(), m, k, number)

    def contains(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[i].passes(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def judge(spark: SparkSession, pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    rules: (verdict, host, path); a rule fits its host and the hosts below it where the path starts with the
    rule's, and the longest that fits decides.  Else a url is blocked if its host or a host above it is ``listed``
    (one column, key).
    """
    tables = Tables(spark)
    rows = pages.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    hosts = rows.select("host").distinct()
    universe = tables.cut(hosts.select(F.explode(host_suffixes(F.col("host"))).alias("key")).distinct(), "cascade-keys")
    listed = tables.cut(listed.select(ascii_lower(F.col("key")).alias("key")).filter("key is not null").distinct(), "cascade-listed")
    blocks = max(1, -(-listed.count() // BLOCK_KEYS))
    hit = F.lit(False)
    for i in range(blocks):
        part = listed.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i) if blocks > 1 else listed
        cascade = Cascade.build(spark, part, universe)
        hit = hit | F.exists(host_suffixes(F.col("host")), cascade.contains)
    tables.drop(universe)
    tables.drop(listed)
    fits = lambda h, p: ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
    rule, verdict = F.lit(None).cast("string"), F.when(hit, "block").otherwise("allow")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        rule, verdict = F.when(fits(h, p), h + p).otherwise(rule), F.when(fits(h, p), what).otherwise(verdict)
    return rows.withColumns({"rule": rule, "verdict": verdict})
