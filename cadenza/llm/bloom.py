"""Bloom filters made and asked by built-in functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import materialize

FALSE_RATE, MOST_HASHES = 0.02, 8
#: Bits in one row of a filter's table (8 MB); larger filters have several rows, each read by itself.
PART_BITS = 1 << 26


class Level:
    """One Bloom filter over ``keys`` (one column, key): a written table of rows (part, bits), read as scalar subqueries.

    The bits are combined before the shuffle, and asking needs no join. Keys are dealt to the parts by a hash. ``number``
    makes the hashes of several filters independent of each other.
    """

    def __init__(self, number: int, keys: DataFrame, count: int, rate: float | None = None):
        self.number = number
        wanted = -count * math.log(rate or FALSE_RATE) / math.log(2) ** 2
        self.parts = max(1, math.ceil(wanted / PART_BITS))
        self.bits = max(64, -(-math.ceil(wanted / self.parts) // 64) * 64)  # of each part
        self.hashes = max(1, min(MOST_HASHES, round(self.bits * self.parts / count * math.log(2)))) if count else 1
        spark = keys.sparkSession
        marks = keys.select(self.part(F.col("key")).alias("part"), F.explode(F.array(*(self.position(F.col("key"), i) for i in range(self.hashes)))).alias("at"))
        each = self.bits // 64
        words = marks.groupBy((F.col("part").cast("long") * each + F.floor(F.col("at") / 64)).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits"))
        dense = spark.range(self.parts * each).withColumnRenamed("id", "word").join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
        rows = dense.groupBy(F.floor(F.col("word") / each).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("all"))
        self.table = materialize(rows.select("part", F.transform("all", lambda s: s["bits"]).alias("bits")), "bloom")

    @classmethod
    def saved(cls, number: int, parts: int, bits: int, hashes: int, table: DataFrame) -> Level:
        """A filter whose table (part, bits) is there."""
        level = cls.__new__(cls)
        level.number, level.parts, level.bits, level.hashes, level.table = number, parts, bits, hashes, table
        return level

    def part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-1 - self.number)), F.lit(self.parts).cast("long")).cast("int")

    def position(self, key: Column, i: int) -> Column:
        """Bit of the i-th hash; two hashes make all (no overflow: both are below the number of bits)."""
        first = F.pmod(F.xxhash64(key, F.lit(2 * self.number)), F.lit(self.bits).cast("long"))
        if not i:
            return first
        step = F.pmod(F.xxhash64(key, F.lit(2 * self.number + 1)), F.lit(self.bits - 1).cast("long")) + 1
        return (first + step * i) % self.bits

    def hits(self, key: Column) -> Column:
        def one(words: Column, i: int) -> Column:
            at = self.position(key, i)
            return F.getbit(F.get(words, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1

        def of(part: int) -> Column:
            words = self.table.where(F.col("part") == part).select("bits").scalar()
            return reduce(lambda a, b: a & b, (one(words, i) for i in range(self.hashes)))

        found = of(0)
        for part in range(1, self.parts):
            found = F.when(self.part(key) == part, of(part)).otherwise(found)
        return found
