"""Floating-point operators with the guest's rules for NaN, zero division and saturation."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ints import unsigned

NAN, INF = float("nan"), float("inf")


def _negative(x: Column) -> Column:
    """Also of -0, which atan2 and comparisons take for 0."""
    return (x < 0) | ((x == 0) & x.cast("string").startswith("-"))


def fdiv(a: Column, b: Column) -> Column:
    """x/0 is an infinity, 0/0 NaN; the sign of a zero divisor counts; null if either is."""
    inf = F.when((a > 0) != _negative(b), F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b != 0, a / F.when(b != 0, b)).when((a == 0) | F.isnan(a), F.lit(NAN)).otherwise(inf)


def fcopysign(x: Column, y: Column) -> Column:
    return F.when(_negative(y), -F.abs(x)).otherwise(F.abs(x))


def fmin(a, b):
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.least(a, b))


def fmax(a, b):
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.greatest(a, b))


def fcmp(condition: str, a, b):
    """eq, ne, lt, le, gt, ge, ord or uno; NaN is unordered."""
    nan = F.isnan(a) | F.isnan(b)
    if condition in ("ord", "uno"):
        return ~nan if condition == "ord" else nan
    if condition == "ne":
        return nan | (a != b)
    return ~nan & {"eq": a == b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[condition]


def _whole(x, rounded):
    """rounded, a bigint, with the sign of x, as -0.5 goes up to -0; from 2^52 on x is whole, an infinity or NaN."""
    return F.when(F.abs(x) < float(1 << 52), fcopysign(rounded.cast("double"), x)).otherwise(x)


def ceil(x):
    return _whole(x, F.ceil(x))


def floor(x):
    return _whole(x, F.floor(x))


def trunc(x):
    return _whole(x, F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))


def nearest(x):
    """Ties to even."""
    return F.rint(x)


def to_sint_sat(x: Column, bits: int) -> Column:
    """Toward zero, saturating; NaN gives 0, null null."""
    top, low = (1 << (bits - 1)) - 1, -(1 << (bits - 1))
    inside = F.when((x < float(top)) & (x > float(low)), x).otherwise(0.0)
    return F.when(x.isNull(), F.lit(None)).when(F.isnan(x), 0).when(x >= float(top), F.lit(top)).when(x <= float(low), F.lit(low)).otherwise(inside.cast("bigint")).cast("bigint")


def to_uint_sat(x: Column, bits: int) -> Column:
    top = (1 << bits) - 1
    inside = F.when((x < float(top)) & (x > 0), x).otherwise(0.0)
    return F.when(x.isNull(), F.lit(None)).when(F.isnan(x) | (x <= 0), F.lit("0").cast("decimal(20,0)")).when(x >= float(top), F.lit(str(top)).cast("decimal(20,0)")).otherwise(F.floor(inside).cast("decimal(20,0)"))


def _fma(a: float, b: float, c: float) -> float:
    try:
        return math.fma(a, b, c)
    except ValueError:  # an infinity times zero, or infinities of both signs
        return NAN
    except OverflowError:
        return INF if (math.copysign(1, a) == math.copysign(1, b)) else -INF


_FMA = F.arrow_udf(lambda a, b, c: pa.array([None if None in x else _fma(*x) for x in zip(a.to_pylist(), b.to_pylist(), c.to_pylist())], pa.float64()), T.DoubleType())


def fma(a, b, c):
    """a * b + c, rounded once; Spark has no fused operation, so it is done by Arrow batches in workers."""
    return _FMA(a.cast("double"), b.cast("double"), c.cast("double"))


def from_uint(x: Column, bits: int) -> Column:
    """The bits read as an unsigned number."""
    return unsigned(x, bits).cast("double")


def bitcast(x: Column, to: str) -> Column:
    """The same bits as another type of that width: bigint and double, int and float; Arrow buffers keep the payload of a NaN."""
    f, was = _BITCASTS[to]
    return f(x.cast(was))


def _viewed(to: pa.DataType, kind: T.DataType):
    return F.arrow_udf(lambda a: a.view(to), kind)


_BITCASTS = {"bigint": (_viewed(pa.int64(), T.LongType()), "double"), "int": (_viewed(pa.int32(), T.IntegerType()), "float"), "double": (_viewed(pa.float64(), T.DoubleType()), "bigint"), "float": (_viewed(pa.float32(), T.FloatType()), "int")}


def fpromote(x):
    return x.cast("float").cast("double")


def fdemote(x):
    return x.cast("float")
