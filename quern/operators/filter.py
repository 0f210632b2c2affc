"""Selection by a constant bound. Nulls never pass, as in SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.types import DEFAULT_BOUND


def filter_lt(df: DataFrame, column: str = "v", bound: int = DEFAULT_BOUND) -> DataFrame:
    """Rows with ``column < bound``; on a stored column the scan gets the predicate."""
    return df.filter(F.col(column) < F.lit(bound))


def mask_lt(df: DataFrame, column: str = "v", bound: int = DEFAULT_BOUND, out: str = "keep") -> DataFrame:
    """The predicate as a column, for every row."""
    return df.withColumn(out, F.col(column) < F.lit(bound))


def filter_mask(df: DataFrame, mask: str = "keep") -> DataFrame:
    return df.filter(F.col(mask))
