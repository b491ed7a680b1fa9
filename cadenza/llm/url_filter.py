"""URL rules and block lists by a Bloom filter cascade, with built-in functions only.

A cascade holds a set of listed keys exactly, relative to the complete universe of keys that the corpus has: the first
level encodes the listed keys, the second those other keys of the universe that the first level takes for listed, the
third the listed keys that the second takes for others, and so on until a level has no false positive left. A key is
listed if it hits the first level and is not taken back by the second, and so on. Judging a url needs only those bit
arrays (read as scalar subqueries), at any size no join, only building it looks the universe's keys up in the list; only
listed keys that occur in the corpus are encoded, and beyond ``bloom.PART_BITS`` a level deals its keys to several arrays.
A cascade may be saved and used again, for urls of its universe.

One cascade serves rules and hosts of both verdicts; a key begins with the list that it belongs to. Keys are bounded in
number for each url: one for each list and shape of rule (labels of the host, characters of the path), and the host.
Defined results: null urls and those without ``://`` have an empty host and path, fit no rule and are allowed; of rules
that fit, the longest wins, and of the same rule in both lists block wins; repeated rows get repeated results; an empty
table an empty one; urls of any length are taken whole; other columns of the input stay, but for ``host``, ``path``,
``rule`` and ``verdict``, which are replaced.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.bloom import Level
from cadenza.llm.common import forget, materialize

#: Each level leaves a few hundredths of its other keys; so many levels mean keys that no hash tells apart.
MOST_LEVELS = 64


def host_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.instr(url, "://") > 0, host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_replace(F.substr(url, F.instr(url, "://") + 3), r"^[^/?#]*", "")
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^?#]*", 0)).otherwise(F.lit(""))


#: Of the levels after the first: their filters need few bits, and a quarter of the other keys goes on.
LATER_RATE = 0.25


class Cascade:
    """Exact membership in ``listed`` for every key of ``universe`` (both: one column, key).

    The first level lets a share of the other keys pass that is about that of the listed ones among all, so that both
    sides of the next level are alike in size; each later level lets a quarter pass.
    """

    def __init__(self, universe: DataFrame, listed: DataFrame):
        keys = universe.select("key").distinct().join(listed.select("key").distinct().withColumn("listed", F.lit(True)), "key", "left")
        keys = materialize(keys.select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "keys")
        self.levels: list[Level] = []
        encode, against = keys.where("listed").select("key"), keys.where("NOT listed").select("key")
        others = against.count()
        while count := encode.count():
            if len(self.levels) == MOST_LEVELS:
                raise RuntimeError("keys of the cascade cannot be told apart")
            rate = LATER_RATE if self.levels else min(LATER_RATE, max(0.7 * count / max(others, 1), 1e-4))
            level = Level(len(self.levels), encode, count, rate)
            self.levels.append(level)
            encode, against = against.where(level.hits(F.col("key"))), encode
        forget(keys)

    def save(self, path: str) -> None:
        """The levels as one table, for other jobs over the same universe."""
        rows = [x.table.select(*(F.lit(v).cast("long").alias(n) for n, v in (("level", x.number), ("parts", x.parts), ("size", x.bits), ("hashes", x.hashes))), "part", "bits") for x in self.levels]
        if not rows:
            raise ValueError("a cascade without listed keys has nothing to save")
        reduce(DataFrame.unionByName, rows).write.mode("overwrite").partitionBy("level").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Cascade:
        table = spark.read.schema("parts long, size long, hashes long, part int, bits array<long>, level long").parquet(path)
        shapes = table.select("level", "parts", "size", "hashes").distinct().orderBy("level").collect()  # a row for each level
        cascade = cls.__new__(cls)
        cascade.levels = [Level.saved(r.level, r.parts, r["size"], r.hashes, table.where(F.col("level") == r.level).select("part", "bits")) for r in shapes]
        return cascade

    def has(self, key: Column) -> Column:
        """For keys of the universe."""
        found = F.lit(False)
        for level in reversed(self.levels):
            found = level.hits(key) & ~found
        return found


class Filter:
    """Rules and a list of hosts as one cascade; ``rules``: (verdict, host, path)."""

    def __init__(self, rules: list[tuple[str, str, str]], cascade: Cascade):
        self.shapes, self.cascade = sorted({(v, h.count(".") + 1, len(p)) for v, h, p in rules}), cascade

    @classmethod
    def build(cls, pages: DataFrame, rules: list[tuple[str, str, str]], blocked_hosts: DataFrame, url_col: str = "url") -> Filter:
        """For the urls of ``pages``, and any part of them; ``blocked_hosts``: one column, host."""
        empty = cls(rules, None)
        universe = pages.select(F.explode(F.array(*empty.keys(*empty.places(url_col)))).alias("key"))
        listed = pages.sparkSession.createDataFrame([(f"{v} rule {h}{p}",) for v, h, p in rules], "key string").unionByName(blocked_hosts.select(F.concat(F.lit("block host "), F.col("host")).alias("key")))
        return cls(rules, Cascade(universe, listed))

    @staticmethod
    def places(url_col: str) -> list[Column]:
        return [F.coalesce(f(F.col(url_col)), F.lit("")) for f in (host_of, path_of)]

    @staticmethod
    def candidate(host: Column, path: Column, labels: int, length: int) -> Column:
        return F.concat(F.substring_index(host, ".", -labels), F.left(path, F.lit(length)))

    def keys(self, host: Column, path: Column) -> list[Column]:
        """Of each shape of rule, and last of the host."""
        return [*(F.concat(F.lit(f"{v} rule "), self.candidate(host, path, n, size)) for v, n, size in self.shapes), F.concat(F.lit("block host "), host)]

    def judge(self, pages: DataFrame, url_col: str = "url") -> DataFrame:
        """``pages`` with host, path, rule, verdict; their urls must be among those that the filter was built for."""
        own = pages.drop("host", "path", "rule", "verdict")
        host, path = self.places(url_col)
        named = own.withColumn("host", host).withColumn("path", path)
        *rule_keys, host_key = self.keys(F.col("host"), F.col("path"))
        fits = [
            F.when(self.cascade.has(key), F.struct(F.length(name := self.candidate(F.col("host"), F.col("path"), n, size)).alias("size"), F.lit(v == "block").alias("block"), name.alias("rule")))
            for (v, n, size), key in zip(self.shapes, rule_keys, strict=True)
        ]
        named = named.withColumn("__best", F.array_max(F.array(*fits))) if fits else named.withColumn("__best", F.lit(None).cast("struct<size int, block boolean, rule string>"))
        verdict = F.when(F.coalesce(F.col("__best.block"), self.cascade.has(host_key)), "block").otherwise("allow")
        return named.select(*own.columns, "host", "path", F.col("__best.rule").alias("rule"), verdict.alias("verdict"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], blocked_hosts: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict, by a filter built for them."""
    return Filter.build(pages, rules, blocked_hosts, url_col).judge(pages, url_col)
