"""Inner equi-joins: global, batch by batch, and over explicit radix partitions.

Duplicated build keys give every match, and keys without a match (or null) give
no row. Output: the left columns, then the right ones without their key. A name
that both sides have gets the suffix ``_l`` or ``_r``.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.partition import bucket, shuffle_to_buckets
from quern.types import free_name


def _apart(left: DataFrame, right: DataFrame, keep: tuple[str, ...], suffixes: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    both = (set(left.columns) & set(right.columns)) - set(keep)
    return (left.withColumnsRenamed({c: c + suffixes[0] for c in both}), right.withColumnsRenamed({c: c + suffixes[1] for c in both}))


def _join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, on: tuple[str, ...], suffixes: tuple[str, str], hint: str | None) -> DataFrame:
    """Joins on the keys and the columns ``on`` that both have."""
    key, own = free_name("__pk", left, right), {c: free_name(f"__{c}", left, right) for c in on}
    left, right = _apart(left, right.withColumnRenamed(right_key, key), on, suffixes)
    left_key = left_key if left_key in left.columns else left_key + suffixes[0]
    right = right.withColumnsRenamed(own)
    cond = F.col(left_key) == F.col(key)
    for c in on:
        cond &= F.col(c) == F.col(own[c])
    return left.join(right.hint(hint) if hint else right, cond, "inner").drop(key, *own.values())


def inner_join(left: DataFrame, right: DataFrame, left_key: str = "fk", right_key: str = "pk", suffixes: tuple[str, str] = ("_l", "_r"), hint: str | None = None) -> DataFrame:
    """Broadcast, shuffled-hash or sort-merge is left to the planner; ``hint`` overrides it."""
    return _join(left, right, left_key, right_key, (), suffixes, hint)


def partition_wise_join(left: DataFrame, right: DataFrame, left_key: str = "fk", right_key: str = "pk", batch: str = "batch_id", suffixes: tuple[str, str] = ("_l", "_r")) -> DataFrame:
    """Only rows of equally numbered batches meet; matches across batches are not found.

    Batch and key are one composite key, so a batch isn't confined to one task.
    """
    return _join(left, right, left_key, right_key, (batch,), suffixes, None)


def join_by_batches(left: DataFrame, right: DataFrame, left_key: str = "fk", right_key: str = "pk", factor: int = 2, batches: int | None = None, batch: str = "batch_id", out: str = "group_id", suffixes: tuple[str, str] = ("_l", "_r")) -> DataFrame:
    """Rows meet within groups of ``factor`` equally numbered batches, named in ``out``.

    With ``batches``, the number of batches on the shorter side, an incomplete last
    group is left out. Group and key are one composite key.
    """
    if factor < 1:
        raise ValueError("a group needs at least one batch")
    left, right = (df.withColumn(out, F.floor(F.col(batch) / factor).cast("long")).drop(batch) for df in (left, right))
    if batches is not None:
        left = left.filter(F.col(out) < batches // factor)
    return _join(left, right, left_key, right_key, (out,), suffixes, None)


def noop_join(left: DataFrame, right: DataFrame, left_key: str = "fk", right_key: str = "pk", suffixes: tuple[str, str] = ("_l", "_r")) -> DataFrame:
    """The schema of ``inner_join`` and no row: what remains is the harness's own cost."""
    return inner_join(left, right, left_key, right_key, suffixes).limit(0)


def radix_join(left: DataFrame, right: DataFrame, left_key: str = "fk", right_key: str = "pk", n: int | None = None, suffixes: tuple[str, str] = ("_l", "_r"), hint: str | None = None) -> DataFrame:
    """Both sides go to the radix bucket of their key, and buckets join by the planner's choice.

    One exchange a side: the join reuses it. There are as many buckets as the
    session has shuffle partitions, rounded up to a power of two, unless ``n`` says
    otherwise. ``hint="shuffle_hash"`` is for a right side whose buckets are known
    to fit in memory. With skewed keys use ``inner_join``, whose exchanges adaptive
    execution may split.
    """
    if n is None:
        n = 1 << (int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    if n < 1 or n & (n - 1):
        raise ValueError("the number of radix partitions must be a power of two")
    part = free_name("__part", left, right)
    dealt = lambda df, key: shuffle_to_buckets(bucket(df, key, n, part).withColumn(part, F.col(part).cast("int")), n, part)  # noqa: E731  an int, so that the join's keys are the exchange's
    return _join(dealt(left, left_key), dealt(right, right_key), left_key, right_key, (part,), suffixes, hint).drop(part)


def hash_build(df: DataFrame, key: str, value: str, out_key: str = "k", out_value: str = "idx") -> DataFrame:
    """One row per key with the largest value: what a table of unique keys would hold,
    with a fixed winner where keys repeat."""
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(out_key)).agg(F.max(value).alias(out_value))


def hash_probe(probe: DataFrame, table: DataFrame, key: str, table_key: str = "k", value: str = "idx", strict: bool = False) -> DataFrame:
    """Each probe row whose key is in the table, with the value found.

    ``strict``: a row without a match raises when it is read, instead of being left out.
    """
    own = free_name("__k", probe, table)
    met = probe.join(table.select(F.col(table_key).alias(own), F.col(value)), F.col(key) == F.col(own), "left" if strict else "inner")
    if strict:
        lost = F.raise_error(F.concat(F.lit(f"no match for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
        met = met.withColumn(value, F.when(F.col(own).isNull(), lost).otherwise(F.col(value)))
    return met.drop(own)


def hash_stats(df: DataFrame, key: str) -> DataFrame:
    """One row about a build side: rows with a key, distinct keys, and the rows of the commonest key."""
    chains = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return chains.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("build_rows"), F.count(F.lit(1)).alias("build_keys"), F.coalesce(F.max("n"), F.lit(0)).alias("longest_chain"))


def require_matches(left: DataFrame, right: DataFrame, left_key: str = "fk", right_key: str = "pk") -> DataFrame:
    """``left`` unchanged if each of its keys is in ``right``; else raises ValueError."""
    own = free_name("__pk", left)
    lost = left.join(right.select(F.col(right_key).alias(own)), F.col(left_key) == F.col(own), "left_anti")
    if not lost.isEmpty():
        raise ValueError(f"{left_key} holds keys that {right_key} lacks")
    return left
