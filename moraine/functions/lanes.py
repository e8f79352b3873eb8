"""Operators on arrays as vector lanes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ints import wrap


def iadd_pairwise(a: Column, b: Column, bits: int) -> Column:
    both = F.concat(a, b)
    return F.transform(F.sequence(F.lit(0), (F.size(both) / 2 - 1).cast("int")), lambda i: wrap(F.get(both, (i * 2).cast("int")) + F.get(both, (i * 2 + 1).cast("int")), bits))


def swizzle(a: Column, lanes: Column) -> Column:
    """Lanes by number; those out of range are 0."""
    return F.transform(lanes, lambda i: F.when((i >= 0) & (i < F.size(a)), F.get(a, i.cast("int"))).otherwise(0))


def extractlane(a, i: int):
    return F.element_at(a, i + 1)


def insertlane(a, i: int, x):
    return F.transform(a, lambda v, k: F.when(k == i, x).otherwise(v))


def splat(x, n: int):
    return F.array_repeat(x, n)


def vall_true(a):
    return F.forall(a, lambda x: x != 0)


def vany_true(a):
    return F.exists(a, lambda x: x != 0)


def vhigh_bits(a):
    """A bit for each negative lane, the first lowest."""
    flags = F.transform(a, lambda x, k: F.when(x < 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), k)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(flags, F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))


def snarrow(a, bits: int):
    top = (1 << (bits - 1)) - 1
    return F.transform(a, lambda x: F.greatest(F.lit(-top - 1), F.least(F.lit(top), x)))


def unarrow(a, bits: int):
    return F.transform(a, lambda x: F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), x)))


def swiden_low(a):
    return F.transform(F.slice(a, 1, (F.size(a) / 2).cast("int")), lambda x: x.cast("bigint"))


def uwiden_low(a, bits: int):
    return F.transform(F.slice(a, 1, (F.size(a) / 2).cast("int")), lambda x: x.cast("bigint").bitwiseAND(F.lit((1 << bits) - 1)))
