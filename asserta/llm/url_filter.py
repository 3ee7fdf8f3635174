"""URL filters by Bloom filter cascades.

A rule is a host and a path; it fits a url of that host or a subdomain whose path starts with the rule's path. A
url's keys are its host's last labels joined to its path's first characters, for the numbers of labels and characters
that rules have. A cascade decides exactly whether a key is listed, for every key that the corpus has: level 0
encodes the listed keys, level 1 the keys of the corpus that level 0 takes for listed by mistake, level 2 the listed
keys that level 1 takes for such mistakes, and so on until a level makes no mistake. Level 0 has the false-positive
rate r / (sqrt(2) s) for r listed keys and s others, and the rest 1/2, which keeps all levels near r log(s / r) bits.
The corpus's keys are scanned once to build; pages are judged by bit tests alone, without joins: the bits come as
literals or, from 512 bytes to at most 8 MB, as scalar subqueries. A rule list too long for that is judged in parts, one pass each.

There is a cascade of blocked keys and one of allowed keys. Of the rules that fit the longest (host and path
together) wins; of equally long ones the greatest as a string; of one listed as both, allow. Without a rule the
verdict is `allow`.

Edge cases: a null url, or one without ``://``, has an empty host and path and no rule. Null ids, repeated rows and
extra columns change nothing; an empty table, and an empty list, work."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asserta.llm._common import MOST_BITS, bloom_bits, bloom_has, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RULES = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("verdict", T.StringType())])
LEAST_RATE = 2.0**-20
LITERAL = 1 << 12  # bits that a query holds as a literal
PER_KEY = 1.45 * 20  # bits of level 0 for a key, at most


class Level(NamedTuple):
    bits: DataFrame | list[int]  # one row, or the words themselves where they are few
    seed: int
    size: int
    hashes: int

    def has(self, key: Column) -> Column:
        bits = F.array(*[F.lit(w).cast("bigint") for w in self.bits]) if isinstance(self.bits, list) else self.bits.scalar()
        return bloom_has(bits, key, self.seed, self.size, self.hashes)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> list[Column]:
    """For each (labels, characters) of the rules, the url's key, null where the url is too short for it."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    return [F.when((host != "") & (labels >= n) & (F.length(path) >= k), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, k))) for n, k in shapes]


def _level(encoded: DataFrame, n: int, rate: float, seed: int) -> Level:
    hashes = max(1, round(-math.log2(rate)))
    size = min(MOST_BITS, 64 * max(1, math.ceil(n * hashes / math.log(2) / 64)))
    bits = bloom_bits(encoded, "key", seed, size, hashes)
    return Level(bits.first()["bits"] if size <= LITERAL else written(bits, "bits"), seed, size, hashes)


def cascade(universe: DataFrame, listed: DataFrame, others: int) -> list[Level]:
    """The levels for the listed keys over a universe of about `others` further keys; both have a column key."""
    listed = written(listed.select("key").where(F.col("key").isNotNull()).distinct(), "listed")
    n = listed.count()
    if not n:
        return []
    levels = [_level(listed, n, min(0.5, max(LEAST_RATE, n / math.sqrt(2) / max(1, others))), 1)]
    mistaken = universe.where(levels[0].has(F.col("key"))).distinct().join(listed, "key", "left_anti")
    good, bad = listed, written(mistaken, "mistaken")
    while n := bad.count():
        levels.append(_level(bad, n, 0.5, len(levels) + 1))
        good, bad = bad, written(good.where(levels[-1].has(F.col("key"))), "mistaken")
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(True)
    for level in reversed(levels[1:]):
        out = ~(level.has(key) & out)
    return levels[0].has(key) & out if levels else F.lit(False)


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (which has a column url) with host, path, rule and verdict in place of any columns so named."""
    out = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(F.concat("host", "path").alias("key"), "host", "path", "verdict")
    rows, n = rules.agg(F.count("*"), F.count_if(F.col("verdict") == "allow")).first()
    parts = max(1, math.ceil(max(n, rows - n) * PER_KEY / MOST_BITS))
    best = F.lit(None).cast("struct<n:int,rule:string,allow:boolean>")
    for k in range(parts):
        part = rules.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k)
        labels = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
        shapes = sorted((r[0], r[1]) for r in part.select(labels, F.length("path")).distinct().collect())
        if not shapes:
            continue
        found = keys(F.col("host"), F.col("path"), shapes)
        universe = out.select(F.explode(F.array_compact(F.array(*found))).alias("key"))
        others = universe.agg(F.approx_count_distinct("key")).first()[0]
        block, allow = (cascade(universe, part.where(F.col("verdict") == v), others) for v in ("block", "allow"))
        hits = [F.when(member(allow, c), F.struct(F.length(c).alias("n"), c.alias("rule"), F.lit(True).alias("allow"))).when(member(block, c), F.struct(F.length(c).alias("n"), c.alias("rule"), F.lit(False).alias("allow"))) for c in found]
        own = F.array_max(F.array_compact(F.array(best, *hits)))
        out = out.withColumn("best__", own)
        if k + 1 < parts:
            out = written(out, "judged")
        best = F.col("best__")
    out = out.withColumns({"rule": best["rule"], "verdict": F.when(best["allow"] | best.isNull(), F.lit("allow")).otherwise("block")})
    return out.drop("best__")
