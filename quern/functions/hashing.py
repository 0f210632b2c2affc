"""32-bit integer mixing and the bucket functions on top of it, in whole-stage code."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.types import U32_MASK


def _mask(c: Column) -> Column:
    return c.bitwiseAND(F.lit(U32_MASK))


#: One function per step: a step refers to its argument twice, so nesting all
#: seven in one expression would double the expression at each.
_STEPS = (
    lambda k: _mask(k.cast("long")),
    lambda h: _mask(h + _mask(F.bitwise_not(F.shiftleft(h, 15)))),
    lambda h: h.bitwiseXOR(F.shiftrightunsigned(h, 10)),
    lambda h: _mask(h + F.shiftleft(h, 3)),
    lambda h: h.bitwiseXOR(F.shiftrightunsigned(h, 6)),
    lambda h: _mask(h + _mask(F.bitwise_not(F.shiftleft(h, 11)))),
    lambda h: h.bitwiseXOR(F.shiftrightunsigned(h, 16)),
)


def wang32(key: Column) -> Column:
    """Thomas Wang's 32-bit integer mix of ``key`` modulo 2^32, as a LONG."""
    for step in _STEPS:
        key = step(key)
    return key


def with_wang32(df: DataFrame, key: str, out: str = "h") -> DataFrame:
    """``df`` with the mix of ``key`` in ``out``, a projection for each step."""
    df = df.withColumn(out, F.col(key))
    for step in _STEPS:
        df = df.withColumn(out, step(F.col(out)))
    return df


def key64_hash(key: Column) -> Column:
    """``k >>> 33 ^ k ^ k << 11`` cut to 32 bits, for 64-bit keys."""
    k = key.cast("long")
    return _mask(F.shiftrightunsigned(k, 33).bitwiseXOR(k).bitwiseXOR(F.shiftleft(k, 11)))


def radix_bucket(h: Column, n: int) -> Column:
    """The top log2(n) bits of a 32-bit hash; n must be a power of two."""
    if n < 1 or n & (n - 1):
        raise ValueError("the number of radix partitions must be a power of two")
    return F.lit(0).cast("long") if n == 1 else F.shiftrightunsigned(h, 32 - (n.bit_length() - 1))
