"""Hash partitions whose identity is data: assignment, histogram, offsets and exchange."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.functions.hashing import radix_bucket, with_wang32
from quern.plans.ranks import dense_positions
from quern.types import free_name, u32


def bucket(df: DataFrame, key: str, n: int, out: str = "part_id", radix: bool = True, mix: bool = True) -> DataFrame:
    """``df`` with the bucket of ``key``: top bits of its hash, or the hash modulo n.

    Without ``mix`` the key's own 32 bits take the hash's place.
    """
    h = free_name("__h", df)
    df = with_wang32(df, key, h) if mix else df.withColumn(h, u32(key))
    part = radix_bucket(F.col(h), n) if radix else F.pmod(F.col(h), F.lit(n))
    return df.withColumn(out, part).drop(h)


def partition_by(df: DataFrame, key: str, n: int, radix: bool = True, mix: bool = True) -> DataFrame:
    """Assigns buckets after the checks that a partition operator owes its caller.

    Rows keep their payload. An empty input gives an empty output; n = 1 puts
    every row in bucket 0.
    """
    if key not in df.columns:
        raise ValueError(f"no column {key}")
    if n < 1:
        raise ValueError("need at least one partition")
    return bucket(df, key, n, radix=radix, mix=mix)


def shuffle_to_buckets(df: DataFrame, n: int, part: str = "part_id") -> DataFrame:
    """Moves each row to the Spark partition with its bucket's number; a null bucket goes to 0."""
    return df.repartitionById(n, F.col(part).cast("int"))


def partition_histogram(df: DataFrame, batch: str = "batch_id", part: str = "part_id") -> DataFrame:
    """Rows by batch and bucket, and the inclusive running count within the batch.

    The window runs over counts, n at most for a batch, not over rows.
    """
    counts = df.groupBy(batch, part).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("end_offset", F.sum("n").over(W.partitionBy(batch).orderBy(part).rowsBetween(W.unboundedPreceding, 0)))


def scatter_positions(df: DataFrame, order: str, part: str = "part_id", out: str = "slot") -> DataFrame:
    """The 0-based slot of each row in its bucket, by ``order``; a bucket may take many tasks."""
    return dense_positions(df, order, out, by=[part])


def one_bucket(df: DataFrame, p: int, part: str = "part_id") -> DataFrame:
    """The rows of bucket ``p``."""
    return df.filter(F.col(part) == p)


def all_buckets(df: DataFrame, n: int, part: str = "part_id") -> list[DataFrame]:
    """The ``n`` buckets as relations of their own, in order; empty ones too."""
    return [one_bucket(df, p, part) for p in range(n)]
