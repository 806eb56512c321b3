"""Key groups: Java's hash codes and the 32-bit Murmur3 finish that assigns keys to groups, as Column expressions.

Products of 32-bit numbers are taken in two halves, so nothing overflows a long under ANSI arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF


def _times(a: Column, constant: int) -> Column:
    low = a.bitwiseAND(F.lit(0xFFFF)) * constant
    high = (F.shiftright(a, 16).bitwiseAND(F.lit(0xFFFF)) * constant).bitwiseAND(F.lit(0xFFFF))
    return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(_MASK))


def _rotate(a: Column, bits: int) -> Column:
    return F.shiftleft(a, bits).bitwiseOR(F.shiftright(a, 32 - bits)).bitwiseAND(F.lit(_MASK))


def _fold(a: Column, bits: int) -> Column:
    return a.bitwiseXOR(F.shiftright(a, bits))


def _signed(a: Column) -> Column:
    return F.when(a >= 1 << 31, a - (1 << 32)).otherwise(a).cast("int")


# Fixed values of Murmur3: the steps of its 32-bit hash of one block and their constants.
_STEPS = (
    lambda a: _times(a, 0xCC9E2D51),
    lambda a: _rotate(a, 15),
    lambda a: _times(a, 0x1B873593),
    lambda a: _rotate(a, 13),
    lambda a: (_times(a, 5) + 0xE6546B64).bitwiseAND(F.lit(_MASK)).bitwiseXOR(F.lit(4)),
    lambda a: _fold(a, 16),
    lambda a: _times(a, 0x85EBCA6B),
    lambda a: _fold(a, 13),
    lambda a: _times(a, 0xC2B2AE35),
    lambda a: _fold(a, 16),
)


def murmur(value: Column) -> Column:
    """Murmur3-32 with seed 0 of an int, as a signed int; null for null.

    Each step is bound once, so the expression grows with the steps and not with the powers of two of their uses.
    """
    h = F.array(value.cast("long").bitwiseAND(F.lit(_MASK)))
    for step in (*_STEPS, _signed):
        h = F.transform(h, step)
    return F.element_at(h, 1)


def with_murmur(frame: DataFrame, value: Column, name: str) -> DataFrame:
    """``frame`` with the hash of an int column: a projection for each step, which stay in generated code."""
    out = frame.withColumn(name, value.cast("long").bitwiseAND(F.lit(_MASK)))
    for step in (*_STEPS, _signed):
        out = out.withColumn(name, step(F.col(name)))
    return out


def with_key_group(frame: DataFrame, hash_code: Column, groups: int, name: str) -> DataFrame:
    """``frame`` with the group of a key by its hash code, as ``key_group`` gives it."""
    return with_murmur(frame, hash_code, name).withColumn(name, F.abs(F.col(name) % groups).cast("int"))


def hash_of_long(value: Column) -> Column:
    """Java's hash code of a long: its halves XORed."""
    v = value.cast("long")
    return _signed(v.bitwiseXOR(F.shiftrightunsigned(v, 32)).bitwiseAND(F.lit(_MASK)))


def hash_of_string(value: Column) -> Column:
    """Java's hash code of a string: the polynomial in 31 of its UTF-16 units; a character beyond the basic plane is two."""
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))

    def step(h: Column, c: Column) -> Column:
        pair = (h * 31 + (F.shiftright(c - 0x10000, 10) + 0xD800)).bitwiseAND(F.lit(_MASK)) * 31 + ((c - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00)
        return F.when(c < 0x10000, h * 31 + c).otherwise(pair).bitwiseAND(F.lit(_MASK))

    return _signed(F.aggregate(codes, F.lit(0).cast("long"), step))


def key_group(hash_code: Column, groups: int) -> Column:
    """The group of a key by its hash code: the size of the remainder that truncates towards zero."""
    return F.abs(murmur(hash_code) % groups).cast("int")
