"""Row numbers over any number of rows without a task that sees them all."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.types import free_name

ROWS_PER_RANGE = 1 << 20
SAMPLES_PER_RANGE = 40
SALTS = 64


def _range_of(value: Column, bounds: Column, n: int) -> Column:
    """How many of the ``n`` ascending bounds are at most ``value``, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    at_most = lambda k: F.coalesce(F.get(bounds, k - 1) <= value, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda pos, step: F.when(at_most(pos + step), pos + step).otherwise(pos))


def dense_positions(df: DataFrame, order: str, out: str = "pos", by: Sequence[str] = (), rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """0-based rank by ``order`` (of any type that sorts), within each group of ``by`` if given.

    Rows are dealt into ranges of about ``rows_per_range`` by the quantiles of a
    sample; a value that fills several ranges is split by a hash of its rows. A
    row's rank is its number in its range plus the rows of the ranges before it.
    Only counts meet in one task; of the sample at most about SAMPLES_PER_RANGE
    values a range are gathered. Nulls sort first; ties have an arbitrary but
    dense order. An empty table gives an empty result; columns may have any name.
    """
    rows = df.count()
    ranges = -(-rows // rows_per_range)
    bounds, heavy = [], []
    if ranges > 1:
        share = min(1.0, ranges * SAMPLES_PER_RANGE / rows)
        values = sorted(r[0] for r in df.select(order).filter(F.col(order).isNotNull()).sample(share, seed=17).collect())
        cuts = [values[len(values) * k // ranges] for k in range(1, ranges)] if values else []
        bounds = sorted(set(cuts))
        heavy = [b for b in bounds if cuts.count(b) > 1]
    at, salt, local, before, n = (free_name(x, df) for x in ("__range", "__salt", "__local", "__before", "__n"))
    kind = df.schema[order].dataType
    array = lambda xs: F.array(*[F.lit(x).cast(kind) for x in xs])
    split = _hashed(df, SALTS)
    cut = df.withColumn(at, F.when(F.col(order).isNull(), -1).otherwise(_range_of(F.col(order), array(bounds), len(bounds)) if bounds else F.lit(0)))
    # A heavy value is the least of its range: its rows come first, salt by salt.
    cut = cut.withColumn(salt, F.when(F.array_contains(array(heavy), F.col(order)), split).otherwise(SALTS) if heavy else F.lit(SALTS))
    if rows > rows_per_range:  # so may nulls be
        cut = cut.withColumn(salt, F.when(F.col(order).isNull(), split).otherwise(F.col(salt)))
    keys = [*by, at, salt]
    counts = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    earlier = F.sum(n).over(W.partitionBy(*by).orderBy(at, salt).rowsBetween(W.unboundedPreceding, 0)) - F.col(n)
    counts = counts.select(*[F.col(k).alias(f"{before}{i}") for i, k in enumerate(keys)], earlier.alias(before))
    numbered = cut.withColumn(local, F.row_number().over(W.partitionBy(*keys).orderBy(order)).cast("long") - 1)
    same = [F.col(k).eqNullSafe(F.col(f"{before}{i}")) for i, k in enumerate(keys)]
    joined = numbered.join(counts, same)
    return joined.select(*[c for c in df.columns if c != out], (F.col(before) + F.col(local)).alias(out))


def _hashed(df: DataFrame, n: int) -> Column:
    """A row's hash modulo ``n``: the same whenever the row is read."""
    return F.pmod(F.xxhash64(*[F.col(c) for c, t in df.dtypes if "map<" not in t and "variant" not in t]), F.lit(n)).cast("int")
