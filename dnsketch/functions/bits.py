"""Bits of 64-bit masks, of 4 KiB bitmap rows, and of large whole numbers in 16-bit limbs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bit(i) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(i) if isinstance(i, int) else i).cast("int"))


def set_bit(mask: Column, i) -> Column:
    return mask.bitwiseOR(_bit(i))


def clear_bit(mask: Column, i) -> Column:
    return mask.bitwiseAND(F.bitwise_not(_bit(i)))


def test_bit(mask: Column, i) -> Column:
    return mask.bitwiseAND(_bit(i)) != 0


def all_set(mask: Column, wanted: Column) -> Column:
    return mask.bitwiseAND(wanted) == wanted


def any_set(mask: Column, wanted: Column) -> Column:
    return mask.bitwiseAND(wanted) != 0


def bits_of(mask: Column) -> Column:
    """The numbers of the set bits, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.getbit(mask, i) == 1)


def has_bit(bitmap: Column, p: Column) -> Column:
    """Whether bit p of a bitmap is set: byte p div 8, bit p mod 8."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftrightunsigned", byte, p.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1


def limbs(hexed: Column) -> Column:
    """Hexadecimal digits of a little-endian number (a multiple of 4 digits) as 16-bit limbs, least significant first."""
    n = F.floor(F.length(hexed) / 4)
    at = lambda i: F.concat(F.substring(hexed, (i * 4 + 3).cast("int"), F.lit(2)), F.substring(hexed, (i * 4 + 1).cast("int"), F.lit(2)))
    return F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.conv(at(i), 16, 10).cast("long"))


def times(number: Column, factor: Column) -> Column:
    """limbs x factor (below 2^32) -> struct(limbs of the same length, overflow): a carry chain."""
    start = F.struct(F.array().cast("array<bigint>").alias("limbs"), F.lit(0).cast("long").alias("overflow"))

    def step(a: Column, x: Column) -> Column:
        p = x * factor.cast("long") + a["overflow"]
        return F.struct(F.array_append(a["limbs"], p.bitwiseAND(F.lit(65535))).alias("limbs"), F.shiftright(p, 16).alias("overflow"))

    return F.aggregate(number, start, step)
