"""Logical unsigned types on Spark's signed ones.

``uint32`` is a LONG in 0..2^32-1 (``checked_u32`` makes sure of it); ``uint64``
sums are LONG, or DECIMAL(20, 0) where wrap-around modulo 2^64 is asked for.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

U32_MASK = 0xFFFFFFFF
DEFAULT_BOUND = 1 << 30  # the filters' constant unless another is given


def u32(c: Column | str) -> Column:
    """Reads a column as an unsigned 32-bit value; a signed int keeps its bits."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("long").bitwiseAND(F.lit(U32_MASK))


def is_u32(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.between(F.lit(0), F.lit(U32_MASK))


def checked_u32(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, whose rows raise when read if one of ``columns`` lies outside the domain. Nulls pass."""
    return df.withColumns({c: F.when(is_u32(c) | F.col(c).isNull(), F.col(c).cast("long")).otherwise(F.raise_error(F.concat(F.lit(f"{c} is no uint32: "), F.col(c).cast("string")))) for c in columns})


def free_name(name: str, *sides: DataFrame) -> str:
    """``name``, or it with underscores before it, that no column of ``sides`` has (in any case)."""
    taken = {c.lower() for df in sides for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def u32_schema(*names: str, nullable: bool = False) -> StructType:
    return StructType([StructField(n, LongType(), nullable) for n in names])
