"""Fixed-width integer arithmetic on signed values held in wider columns.

``bits`` is 8, 16, 32 or 64.  Values are computed as bigint (64 bits: as
decimal(38,0)), in which no sum or signed product overflows, and wrapped back;
ANSI mode would otherwise raise where these wrap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEC = "decimal(38,0)"


def _kind(bits: int) -> str:
    """What holds sums and signed products: bigint up to 32 bits, as it stays in generated code."""
    return "bigint" if bits <= 32 else DEC


def wide(x: Column, bits: int) -> Column:
    return x.cast(_kind(bits))


def _two(n: int, bits: int) -> Column:
    return F.lit(1 << n).cast("bigint") if bits <= 32 else F.lit(str(1 << n)).cast(DEC)


def unsigned(x: Column, bits: int) -> Column:
    """The same bits read as an unsigned number."""
    d = wide(x, bits)
    return F.when(d < 0, d + _two(bits, bits)).otherwise(d).cast(_kind(bits))


def wrap(x: Column, bits: int) -> Column:
    """Any number reduced to ``bits`` bits, two's complement."""
    half = _two(bits - 1, bits)
    return (F.pmod(wide(x, bits) + half, _two(bits, bits)) - half).cast("bigint")


def iadd(a, b, bits):
    return wrap(wide(a, bits) + wide(b, bits), bits)


def isub(a, b, bits):
    return wrap(wide(a, bits) - wide(b, bits), bits)


def imul(a, b, bits):
    """Widths up to 32, and 64 where the product has under 38 digits."""
    return wrap(wide(a, bits) * wide(b, bits), bits)


def ineg(a, bits):
    return wrap(-wide(a, bits), bits)


def iabs(a, bits):
    return wrap(F.abs(wide(a, bits)), bits)


def _quotient(a: Column, b: Column, bits: int) -> Column:
    """Toward zero, exact: what is divided is a multiple."""
    return ((a - a % b) / b).cast(_kind(bits))


def udiv(a, b, bits):
    """Null (where the original traps) if b is 0."""
    return F.when(b != 0, wrap(_quotient(unsigned(a, bits), unsigned(b, bits), bits), bits))


def urem(a, b, bits):
    return F.when(b != 0, wrap(unsigned(a, bits) % unsigned(b, bits), bits))


def sdiv(a, b, bits):
    """Null if b is 0 or the quotient doesn't fit."""
    q = _quotient(wide(a, bits), wide(b, bits), bits)
    return F.when((b != 0) & (q < _two(bits - 1, bits)), q.cast("bigint"))


def srem(a, b, bits):
    return F.when(b != 0, (wide(a, bits) % wide(b, bits)).cast("bigint"))


def band_not(a, b):
    return a.bitwiseAND(F.bitwise_not(b))


def bor_not(a, b):
    return a.bitwiseOR(F.bitwise_not(b))


def bxor_not(a, b):
    return a.bitwiseXOR(F.bitwise_not(b))


def bitselect(c, x, y):
    return c.bitwiseAND(x).bitwiseOR(F.bitwise_not(c).bitwiseAND(y))


def _amount(n: Column, bits: int) -> Column:
    return F.pmod(n.cast("bigint"), F.lit(bits)).cast("int")


def mask(x: Column, bits: int) -> Column:
    """The low bits of a bigint, as a non-negative bigint for widths under 64."""
    return x.cast("bigint") if bits == 64 else x.cast("bigint").bitwiseAND(F.lit((1 << bits) - 1))


def sign(x: Column, bits: int) -> Column:
    """A masked bigint back to signed."""
    return x if bits == 64 else F.shiftright(F.shiftleft(x, 64 - bits), 64 - bits)


def ishl(x, n, bits):
    return sign(mask(F.call_function("shiftleft", mask(x, bits), _amount(n, bits)), bits), bits)


def ushr(x, n, bits):
    return sign(F.call_function("shiftrightunsigned", mask(x, bits), _amount(n, bits)), bits)


def sshr(x, n, bits):
    return F.call_function("shiftright", x.cast("bigint"), _amount(n, bits))


def rotl(x, n, bits):
    k = _amount(n, bits)
    other = ((F.lit(bits) - k) % bits).cast("int")
    m = mask(x, bits)
    return sign(mask(F.call_function("shiftleft", m, k).bitwiseOR(F.call_function("shiftrightunsigned", m, other)), bits), bits)


def rotr(x, n, bits):
    return rotl(x, F.lit(bits) - _amount(n, bits), bits)


def clz(x, bits):
    """Ones are smeared below the highest; what is left are the zeros before it."""
    m = mask(x, bits)
    for n in (1, 2, 4, 8, 16, 32):
        m = m.bitwiseOR(F.call_function("shiftrightunsigned", m, F.lit(n)))
    return (F.lit(bits) - F.bit_count(m)).cast("int")


def ctz(x, bits):
    m, least = mask(x, bits), F.lit(-(2**63))
    return F.when(m == 0, bits).when(m == least, 63).otherwise(F.bit_count(m.bitwiseAND(-m) - 1)).cast("int")


def cls(x, bits):
    """Leading bits, after the first, that equal the sign."""
    return (clz(F.when(x < 0, F.bitwise_not(x.cast("bigint"))).otherwise(x.cast("bigint")), bits) - 1).cast("int")


def popcnt(x, bits):
    return F.bit_count(mask(x, bits))


# Every second bit, pair, nibble, byte, ...
EVERY_OTHER = {1: 0x5555555555555555, 2: 0x3333333333333333, 4: 0x0F0F0F0F0F0F0F0F, 8: 0x00FF00FF00FF00FF, 16: 0x0000FFFF0000FFFF, 32: 0x00000000FFFFFFFF}


def _swapped(x: Column, bits: int, steps: tuple) -> Column:
    """Neighbouring groups of each size trade places; what was in the low bits is brought back down."""
    m = mask(x, bits)
    for n in steps:
        half = F.lit(EVERY_OTHER[n])
        m = F.call_function("shiftrightunsigned", m, F.lit(n)).bitwiseAND(half).bitwiseOR(F.call_function("shiftleft", m.bitwiseAND(half), F.lit(n)))
    return sign(F.call_function("shiftrightunsigned", m, F.lit(64 - bits)), bits)


def bitrev(x, bits):
    return _swapped(x, bits, (1, 2, 4, 8, 16, 32))


def bswap(x, bits):
    return _swapped(x, bits, (8, 16, 32))


def _reverse_bytes(digits: Column) -> Column:
    """Hex digits with their pairs in reverse order; reverse() of binary goes by characters."""
    return F.regexp_replace(F.reverse(digits), "(.)(.)", "$2$1")


def umin(a, b, bits):
    return F.when(unsigned(a, bits) <= unsigned(b, bits), a).otherwise(b)


def umax(a, b, bits):
    return F.when(unsigned(a, bits) >= unsigned(b, bits), a).otherwise(b)


def smulhi(a, b, bits):
    p = wide(a, bits) * wide(b, bits)
    return ((p - F.pmod(p, _two(bits, bits))) / _two(bits, bits)).cast("bigint")


def umulhi(a, b, bits):
    """64 bits by four products of halves, as a whole product can have 39 digits."""
    if bits < 64:
        more = 2 * bits if bits < 32 else 64
        p = unsigned(a, bits).cast(_kind(more)) * unsigned(b, bits).cast(_kind(more))
        return wrap(((p - F.pmod(p, _two(bits, more))) / _two(bits, more)).cast(_kind(more)), bits)
    two = _two(32, 64)
    low = lambda x: (x % two).cast(DEC)
    high = lambda x: _quotient(x, two, 64)
    ua, ub = unsigned(a, 64), unsigned(b, 64)
    middle = (high(ua) * low(ub)).cast(DEC) + (low(ua) * high(ub)).cast(DEC) + high((low(ua) * low(ub)).cast(DEC))
    return wrap((high(ua) * high(ub)).cast(DEC) + high(middle.cast(DEC)), 64)


def uadd_sat(a, b, bits):
    return wrap(F.least(unsigned(a, bits) + unsigned(b, bits), _two(bits, bits) - 1), bits)


def usub_sat(a, b, bits):
    return wrap(F.greatest(unsigned(a, bits) - unsigned(b, bits), F.lit(0).cast(_kind(bits))), bits)


def _clamp(x: Column, bits: int) -> Column:
    return F.greatest(-_two(bits - 1, bits), F.least(x, _two(bits - 1, bits) - 1)).cast("bigint")


def sadd_sat(a, b, bits):
    return _clamp(wide(a, bits) + wide(b, bits), bits)


def ssub_sat(a, b, bits):
    return _clamp(wide(a, bits) - wide(b, bits), bits)


def avg_round(a, b, bits):
    s = unsigned(a, bits) + unsigned(b, bits) + 1
    return wrap(_quotient(s, F.lit(2).cast(_kind(bits)), bits), bits)


def uadd_overflow(a, b, bits):
    s = unsigned(a, bits) + unsigned(b, bits)
    return F.struct(wrap(s, bits).alias("value"), (s >= _two(bits, bits)).alias("overflow"))


def smul_overflow(a, b, bits):
    p = wide(a, bits) * wide(b, bits)
    return F.struct(wrap(p, bits).alias("value"), ((p >= _two(bits - 1, bits)) | (p < -_two(bits - 1, bits))).alias("overflow"))


def uextend(x, bits):
    return unsigned(x, bits)


def sextend(x, bits):
    return wrap(x, bits)


def ireduce(x, bits):
    return wrap(x, bits)


CONDITIONS = ("eq", "ne", "slt", "sle", "sgt", "sge", "ult", "ule", "ugt", "uge")


def icmp(condition: str, a, b, bits):
    if condition[0] == "u":
        a, b = unsigned(a, bits), unsigned(b, bits)
    return {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[condition[-2:]]


def u64_le(x: Column, first: int) -> Column:
    """Eight little-endian bytes from position ``first`` (1-based) as decimal(20,0): the full unsigned range."""
    return F.conv(_reverse_bytes(F.hex(F.substring(x, first, 8))), 16, 10).cast("decimal(20,0)")


def to_u64_le(x: Column) -> Column:
    return F.unhex(_reverse_bytes(F.lpad(F.hex(x.cast("bigint")), 16, "0")))
