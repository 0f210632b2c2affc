"""Rounding helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_up_multiple(c: Column, of: int = 8) -> Column:
    """The least multiple of ``of`` (a power of two) that is at least ``c``."""
    if of < 1 or of & (of - 1):
        raise ValueError("of must be a power of two")
    return (c.cast("long") + F.lit(of - 1)).bitwiseAND(F.lit(-of))


def round_up_pow2(c: Column) -> Column:
    """The least power of two that is at least ``c``; 1 for c <= 1.

    Counts the binary digits of ``c - 1`` instead of taking a logarithm, which
    would lose exactness near large powers.
    """
    c = c.cast("long")
    digits = F.length(F.bin(c - F.lit(1))).cast("int")
    return F.when(c.isNull(), F.lit(None)).when(c <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), digits))


def minimum(a: Column, b: Column) -> Column:
    """The smaller value; null if either is, as a comparison has it."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))
