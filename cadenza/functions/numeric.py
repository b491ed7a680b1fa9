"""Arithmetic that ANSI mode and 64-bit integers make delicate."""

from __future__ import annotations

import struct
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME_LOW = 14695981039346656037, 435


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fnv_start(seed: int) -> int:
    """State of the hash after the seed's four little-endian bytes."""
    state = FNV_OFFSET
    for byte in struct.pack("<i", seed):
        state = (state ^ byte) * 0x100000001B3 % (1 << 64)
    return state


def seeded_bucket(identifier: Column, seed: int, buckets: int = 1_000_000) -> Column:
    """FNV-1a of the seed's bytes and an ASCII identifier, modulo an even number of buckets, without overflow."""
    codes = F.transform(F.sequence(F.lit(1), F.length(identifier)), lambda i: F.ascii(F.substr(identifier, i, F.lit(1))).cast("long"))
    mask = F.lit(0xFFFFFFFF).cast("long")

    def step(state: Column, byte: Column) -> Column:
        x = state.bitwiseXOR(byte)
        low, high = x.bitwiseAND(mask), F.shiftrightunsigned(x, 32)
        first = low * FNV_PRIME_LOW
        top = high * FNV_PRIME_LOW + F.shiftrightunsigned(first, 32) + F.shiftleft(low, 8)
        return F.shiftleft(top.bitwiseAND(mask), 32).bitwiseOR(first.bitwiseAND(mask))

    start = F.lit(_signed(fnv_start(seed))).cast("long")
    state = F.when(F.length(identifier) > 0, F.aggregate(codes, start, step)).otherwise(start)
    return F.pmod(F.shiftrightunsigned(state, 1), F.lit(buckets // 2).cast("long")) * 2 + state.bitwiseAND(F.lit(1).cast("long"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over complete pairs; null for fewer than two or without variance (plain ``corr`` throws)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when(F.count(F.when(both, 1)) >= 2, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """0 where either vector has no length."""
    return F.when((norm_a == 0) | (norm_b == 0), 0.0).otherwise(dot(a, b) / (norm_a * norm_b))


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> tuple[Column, Column]:
    """(value in the range, whether it was outside); not a number counts as 0 and outside."""
    odd = F.isnan(value)
    return F.when(odd, 0.0).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), value))), odd | (value < low) | (value > high)


def all_present(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
