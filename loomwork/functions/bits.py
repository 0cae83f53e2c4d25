"""Eight-bit strings and Roman numerals as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def eight(n: Column) -> Column:
    return F.lpad(F.bin(n), 8, "0")


def value(bits: Column) -> Column:
    return F.conv(bits, 2, 10).cast("long")


def invert(bits: Column) -> Column:
    return F.translate(bits, "01", "10")


def rotate_left(bits: Column, k: Column | int) -> Column:
    k = F.lit(k) if isinstance(k, int) else k
    return F.concat(F.substring(bits, k + 1, F.char_length(bits)), F.substring(bits, F.lit(1), k))


def rotate_right(bits: Column, k: Column | int) -> Column:
    k = F.lit(k) if isinstance(k, int) else k
    return rotate_left(bits, F.char_length(bits) - k)


def shift_left(bits: Column, k: int) -> Column:
    return F.rpad(F.substring(bits, F.lit(k + 1), F.char_length(bits)), 8, "0")


def shift_right(bits: Column, k: int) -> Column:
    return F.concat(F.lit("0" * k), F.substring(bits, F.lit(1), F.char_length(bits) - k))


def masked(bits: Column, mask: Column, op: str) -> Column:
    a, b = value(bits), value(mask)
    return eight({"and": a.bitwiseAND(b), "or": a.bitwiseOR(b), "xor": a.bitwiseXOR(b)}[op])


def roman(n: Column) -> Column:
    """1 to 3999; a digit a table."""
    # The symbols of each decimal place.
    tables = (("", "M", "MM", "MMM"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))
    return F.concat(*[F.get(F.array(*map(F.lit, t)), (F.floor(n / k) % 10).cast("int")) for k, t in zip((1000, 100, 10, 1), tables, strict=True)])
