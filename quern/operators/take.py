"""Gather by position. A position is data: rows of a DataFrame have no order of their own."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.ranks import dense_positions
from quern.types import free_name


def positions(df: DataFrame, order: str, out: str = "pos") -> DataFrame:
    """0-based positions by ``order``, over any number of partitions."""
    return dense_positions(df, order, out)


def _gather(indices: DataFrame, data: DataFrame, on: list[str], index: str, pos: str) -> DataFrame:
    taken = [c for c in data.columns if c not in (pos, *on)]
    if both := set(taken) & set(indices.columns):
        raise ValueError(f"both sides have {sorted(both)}")
    own = {c: free_name(f"__{c}", indices, data) for c in [pos, *on]}
    cond = F.col(index) == F.col(own[pos])
    for c in on:
        cond &= F.col(c) == F.col(own[c])
    return indices.join(data.withColumnsRenamed(own), cond, "inner").select(*indices.columns, *taken)


def take(indices: DataFrame, data: DataFrame, index: str = "i", pos: str = "pos") -> DataFrame:
    """A row per index with the data row at that position; repeats allowed.

    Indices out of range give no row. The order of the result is that of
    ``indices``' own position column, which it keeps.
    """
    return _gather(indices, data, [], index, pos)


def take_batched(indices: DataFrame, data: DataFrame, index: str = "i", pos: str = "pos", batch: str = "batch_id") -> DataFrame:
    """``take`` within each batch: positions count from 0 in every batch."""
    return _gather(indices, data, [batch], index, pos)


def batch_positions(df: DataFrame, order: str, batch: str = "batch_id", out: str = "pos") -> DataFrame:
    """0-based positions by ``order`` within each batch."""
    return dense_positions(df, order, out, by=[batch])
