"""Global aggregates, whole or as explicit partial and final phases."""

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUNCTIONS = ("sum", "count", "min", "max", "avg")


def scalar_agg(df: DataFrame, fn: str = "sum", column: str = "v", out: str | None = None) -> DataFrame:
    """One row with ``fn`` of ``column``, named like ``sum(v)`` unless ``out`` is given.

    Spark combines on the map side, so one row per task is exchanged. A sum
    beyond 2^63 raises in ANSI mode; see ``sum_u32`` and ``sum_wrapping``.
    """
    return scalar_aggs(df, [fn], column, [out or f"{fn}({column})"])


def scalar_aggs(df: DataFrame, fns: list[str], column: str = "v", outs: list[str] | None = None) -> DataFrame:
    """One row with several aggregates of ``column``, in one pass."""
    if unknown := [f for f in fns if f not in FUNCTIONS]:
        raise ValueError(f"no such aggregate: {', '.join(unknown)}")
    return df.agg(*[getattr(F, f)(column).alias(o) for f, o in zip(fns, outs or [f"{f}({column})" for f in fns], strict=True)])


def _modulo(total: Column, out: str) -> Column:
    return F.pmod(total, F.lit(Decimal(1 << 64))).cast("decimal(20,0)").alias(out)


def sum_u32(df: DataFrame, column: str = "v", out: str = "sum") -> DataFrame:
    """The sum of unsigned 32-bit values modulo 2^64 as DECIMAL(20, 0), for any number of rows.

    Tasks add longs (a task's fewer than 2^31 rows can't reach 2^63); their
    partial sums alone are added as decimals.
    """
    partial = df.groupBy(F.spark_partition_id().alias("task")).agg(F.sum(column).alias("part"))
    return partial.agg(_modulo(F.sum(F.col("part").cast("decimal(28,0)")), out))


def sum_wrapping(df: DataFrame, column: str = "v", out: str = "sum") -> DataFrame:
    """The sum modulo 2^64 as DECIMAL(20, 0), as unsigned 64-bit addition gives it.

    DECIMAL(28, 0) sums as DECIMAL(38, 0): enough for 10^18 of the largest values.
    """
    return df.agg(_modulo(F.sum(F.col(column).cast("decimal(28,0)")), out))


def partial_sums(df: DataFrame, by: str = "batch_id", column: str = "v", out: str = "partial_sum") -> DataFrame:
    return df.groupBy(by).agg(F.sum(column).alias(out))


def merge_partials(partials: DataFrame, column: str = "partial_sum", out: str = "total") -> DataFrame:
    return partials.agg(F.sum(column).alias(out))


def count_rows(df: DataFrame, out: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(out))
