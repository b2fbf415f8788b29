"""256-bit integers as 32-byte big-endian words, and sums of them in eight 32-bit limbs.

Big-endian words sort as their numbers. A sum of limbs is exact up to 2**31 rows for each key and
combine on the map side; carrying the limbs afterwards gives the sum modulo 2**256.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMBS = 8
MODULUS = 1 << 256
_BASE = 1 << 32
WORD_END = 29


def _bytes(word: Column, start: int, n: int) -> Column:
    return F.call_function("substring", word, F.lit(start), F.lit(n))


def limb(word: Column, k: int) -> Column:
    """The k-th 32-bit limb from the low end, as a long."""
    return F.conv(F.hex(_bytes(word, WORD_END - 4 * k, 4)), 16, 10).cast("long")


def limbs(word: Column) -> Column:
    return F.array(*[limb(word, k) for k in range(LIMBS)])


def from_limbs(parts: list[Column]) -> Column:
    """Carry signed limb sums into a word modulo 2**256, by a fold so that no limb's expression is repeated."""
    carried = F.aggregate(
        F.array(*[p.cast("long") for p in parts]),
        F.struct(F.lit(0).cast("long").alias("carry"), F.lit("").alias("text")),
        lambda a, x: F.struct(
            F.shiftright(a["carry"] + x, 32).alias("carry"),
            F.concat(F.lpad(F.hex((a["carry"] + x).bitwiseAND(F.lit(_BASE - 1))), 8, "0"), a["text"]).alias("text"),
        ),
        lambda a: a["text"],
    )
    return F.unhex(carried)


def _low_half(c: Column) -> Column:
    """The low four bytes of a long."""
    return F.unhex(F.lpad(F.hex(c.bitwiseAND(F.lit(_BASE - 1))), 8, "0"))


def signed_sum(word: Column, sign: Column | int = 1) -> Column:
    """An aggregate: the sum of sign * word modulo 2**256. sign is 1 or -1 for each row.

    Most limbs are all zeros, or all ones in small negative words, which need no conversion; the carry is plain
    arithmetic on the eight sums, since an aggregate's repeated sum is taken once.
    """
    def part(k: int) -> Column:
        raw = _bytes(word, WORD_END - 4 * k, 4)
        return F.when(raw == F.lit(bytes(4)), F.lit(0).cast("long")).when(raw == F.lit(b"\xff" * 4), F.lit(_BASE - 1)).otherwise(limb(word, k))

    words, carry = [], None
    for k in range(LIMBS):
        now = F.sum(part(k) * sign)
        now = now if carry is None else now + carry
        words.append(_low_half(now))
        carry = F.shiftright(now, 32)
    return F.concat(*reversed(words))


def add(a: Column, b: Column) -> Column:
    return from_limbs([limb(a, k) + limb(b, k) for k in range(LIMBS)])


def subtract(a: Column, b: Column) -> Column:
    return from_limbs([limb(a, k) - limb(b, k) for k in range(LIMBS)])


def lit(value: int) -> Column:
    return F.lit((value % MODULUS).to_bytes(32, "big"))


def from_little_endian(word: Column) -> Column:
    """The bytes of a little-endian record as a word."""
    return F.unhex(F.array_join(F.reverse(F.array(*[F.hex(_bytes(word, k, 1)) for k in range(1, 33)])), ""))


def narrow(word: Column, bits: int, signed: bool) -> Column:
    """The low `bits` of a word: a long up to 56, a decimal(38,0) up to 120, else a word, sign-extended if signed."""
    n = bits // 8
    low = _bytes(word, 33 - n, n)
    negative = _bytes(low, 1, 1) >= F.lit(b"\x80")
    if bits <= 56:
        value = F.conv(F.hex(low), 16, 10).cast("long")
        return F.when(negative, value - (1 << bits)).otherwise(value) if signed else value
    if bits <= 120:
        kind = "decimal(38,0)"
        value = F.lit(0).cast(kind)
        for k in range(-(-n // 4)):
            start = max(1, n - 4 * k - 3)
            piece = F.conv(F.hex(_bytes(low, start, n - 4 * k - start + 1)), 16, 10).cast("decimal(10,0)")
            value = (value + piece * F.lit(_decimal(1 << (32 * k)))).cast(kind)
        return F.when(negative, (value - F.lit(_decimal(1 << bits))).cast(kind)).otherwise(value) if signed else value
    if bits == 256:
        return word
    fill = F.when(negative, F.lit(b"\xff" * (32 - n))).otherwise(F.lit(bytes(32 - n))) if signed else F.lit(bytes(32 - n))
    return F.concat(fill, low)


def _decimal(value: int):
    from decimal import Decimal

    return Decimal(value)


def to_text(word: Column) -> Column:
    """The decimal digits of a word, without a UDF: limbs of base 10**9, folded from the high end."""
    start = F.expr("cast(array(0,0,0,0,0,0,0,0,0) as array<bigint>)")
    high_first = F.array(*[limb(word, k) for k in reversed(range(LIMBS))])

    def step(digits, x):
        # digits * 2**32 + x in base 10**9, low digit first
        folded = F.aggregate(
            digits, F.struct(x.alias("carry"), F.expr("cast(array() as array<bigint>)").alias("out")),
            lambda a, d: F.struct(
                F.floor((d * _BASE + a["carry"] - (d * _BASE + a["carry"]) % (10**9)) / (10**9)).alias("carry"),
                F.array_append(a["out"], (d * _BASE + a["carry"]) % (10**9)).alias("out")),
            lambda a: a["out"])
        return folded

    digits = F.aggregate(high_first, start, step)
    text = F.array_join(F.transform(F.reverse(digits), lambda d: F.lpad(d.cast("string"), 9, "0")), "")
    large = F.coalesce(F.nullif(F.ltrim(text, F.lit("0")), F.lit("")), F.when(word.isNotNull(), F.lit("0")))
    # most amounts fit 64 bits, where one conversion does
    return F.when(_bytes(word, 1, 24) == F.lit(bytes(24)), F.conv(F.hex(_bytes(word, 25, 8)), 16, 10)).otherwise(large)
