"""Concatenation, multi-key sort and positional columns."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def concat_all(*parts: DataFrame) -> DataFrame:
    """UNION ALL by column name."""
    if not parts:
        raise ValueError("nothing to concatenate")
    return reduce(DataFrame.unionByName, parts)


def sort_by(df: DataFrame, *keys: str) -> DataFrame:
    """Ascending by all keys: range-partitioned, then sorted in each partition."""
    return df.orderBy(*[F.col(k).asc() for k in keys])


def add_columns(df: DataFrame, other: DataFrame, position: str) -> DataFrame:
    """Appends the columns of ``other``, row by row, by a position that both carry."""
    return df.join(other, position, "inner").select(*df.columns, *[c for c in other.columns if c != position])
