"""Exact deduplication by two passes over a Bloom filter.

Pass 1 hashes every text and counts, up to two, how many rows set each cell of a
Bloom filter. A text that occurs twice has set each of its cells twice, so the
cells that reached two form a filter of *possibly repeated* hashes without false
negatives. Pass 2 asks that filter; rows it rules out are unique and pass
straight through. Only the others (repeats and a few false positives) shuffle,
and an exact grouping by SHA-256 decides about them.

Scale. A task sends one compact row per slice of the filter that it touched, not
a row per document. The filter has 16 cells a row, up to ``max_cells`` (2^30 by
default: 128 MB), which bounds what the driver merges and broadcasts. Beyond
that size (about 67 million rows) false positives rise and more rows shuffle;
the result stays exact. Hot groups: groups are aggregated before
the exchange, and their result joins back through exchanges that adaptive
execution splits.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SPACE, free_name, saved, text_of

CELLS_PER_ROW = 16
PROBES = 3
SLICE = 1 << 20  # cells in a slice
CHUNK = 1 << 20  # rows whose cells are held at once


def normalised(text: str = "text") -> Column:
    """The text without ASCII white space; null is empty."""
    return F.regexp_replace(text_of(text), SPACE + "+", "")


def _cells(high: np.ndarray, low: np.ndarray, cells: int) -> np.ndarray:
    """The cells of each 128-bit hash, a row of PROBES for each (double hashing)."""
    step = low.astype(np.uint64) | np.uint64(1)
    return np.stack([(high.astype(np.uint64) + np.uint64(i) * step) % np.uint64(cells) for i in range(PROBES)], axis=1)


def _count_cells(cells: int):
    """Per CHUNK rows of a task and slice: the offsets set by one row, and those set by several."""

    def packed(seen: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cell, n = np.unique(np.concatenate(seen), return_counts=True)
        part = cell // np.uint64(SLICE)
        cuts = np.flatnonzero(np.diff(part)) + 1
        for i, j in zip([0, *cuts], [*cuts, len(cell)], strict=True):
            if i == j:
                continue
            at = (cell[i:j] % np.uint64(SLICE)).astype(np.uint32)
            once, more = at[n[i:j] == 1], at[n[i:j] > 1]
            pack = lambda x: zlib.compress(np.diff(x, prepend=np.uint32(0)).astype("<u4").tobytes(), 1)
            yield pa.RecordBatch.from_pydict({"slice": pa.array([int(part[i])], pa.int64()), "once": pa.array([pack(once)], pa.binary()), "more": pa.array([pack(more)], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = [], 0
        for b in batches:
            seen.append(_cells(b.column(0).to_numpy(), b.column(1).to_numpy(), cells).ravel())
            rows += b.num_rows
            if rows >= CHUNK:
                yield from packed(seen)
                seen, rows = [], 0
        if rows:
            yield from packed(seen)

    return run


def _merge_slice(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bits of the cells of one slice that at least two rows set."""
    count = np.zeros(SLICE, np.uint8)
    for pdf in parts:
        for once, more in zip(pdf["once"], pdf["more"], strict=True):
            for packed, by in ((once, 1), (more, 2)):
                at = np.cumsum(np.frombuffer(zlib.decompress(packed), "<u4"), dtype=np.uint32)
                count[at] = np.minimum(count[at] + by, 2)
    yield pd.DataFrame({"slice": [key[0]], "bits": [zlib.compress(np.packbits(count >= 2).tobytes(), 1)]})


class RepeatFilter:
    """Bloom filter of the hashes that may occur in more than one row."""

    def __init__(self, hashes: DataFrame, max_cells: int = 1 << 30):
        """``hashes``: two long columns, the halves of each row's hash."""
        rows = hashes.count()
        self.cells = min(max_cells, max(SLICE, 1 << (CELLS_PER_ROW * max(rows, 1) - 1).bit_length()))
        parts = hashes.mapInArrow(_count_cells(self.cells), "slice long, once binary, more binary")
        merged = parts.groupBy("slice").applyInPandas(_merge_slice, "slice long, bits binary")
        bits = np.zeros(self.cells // 8, np.uint8)  # at most max_cells / 8 bytes
        for r in merged.toLocalIterator():
            bits[r["slice"] * (SLICE // 8) : (r["slice"] + 1) * (SLICE // 8)] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
        self._bits = hashes.sparkSession.sparkContext.broadcast(bits.tobytes())

    def may_repeat(self, high: Column, low: Column) -> Column:
        cells, bits = self.cells, self._bits

        @F.pandas_udf("boolean")
        def probe(a: pd.Series, b: pd.Series) -> pd.Series:
            at, have = _cells(a.to_numpy(), b.to_numpy(), cells), np.frombuffer(bits.value, np.uint8)
            return pd.Series(((have[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1))

        return probe(high, low)


def _halves(sha: Column) -> list[Column]:
    """Two longs out of a SHA-256's hex digits, 60 bits each."""
    return [F.conv(F.substring(sha, 1 + 15 * i, 15), 16, 10).cast("long") for i in range(2)]


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_cells: int = 1 << 30) -> DataFrame:
    """Every row's group of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree without ASCII white space. The row of most
    code points stays, then that of the smallest id. Null and empty texts are
    one group. Repeated rows (same id, same text) each appear, count towards
    group_size and share ``kept``. A null id sorts after all others. An empty
    table gives an empty result; other columns are not read.
    """
    sha = F.sha2(normalised(text_column), 256)
    prints = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.length(text_of(text_column)).cast("long").alias("size"), sha.alias("text_sha256"))
    prints = saved(prints.select("*", *[h.alias(n) for h, n in zip(_halves(F.col("text_sha256")), ("high", "low"), strict=True)]))
    repeats = RepeatFilter(prints.select("high", "low"), max_cells)
    asked = prints.select("doc_id", "size", "text_sha256", repeats.may_repeat(F.col("high"), F.col("low")).alias("maybe"))
    maybe = saved(asked.filter("maybe").select("doc_id", "size", "text_sha256"))
    order = F.struct(F.col("size"), F.col("doc_id").isNotNull(), -F.coalesce(F.col("doc_id"), F.lit(0)))
    groups = saved(maybe.groupBy("text_sha256").agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("group_size")))
    groups = groups.select("text_sha256", F.when(F.col("best.col2"), -F.col("best.col3")).alias("keep_id"), "group_size")
    joined = maybe.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    alone = asked.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionAll(joined)


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_cells: int = 1 << 30) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept.

    The choice is that of ``exact_groups``; between rows alike in length and id,
    the one whose other columns hash highest stays, and of rows alike in
    everything one stays. Whole rows shuffle only where the filter asks for it,
    after the best of each group in a task is chosen. An empty table gives an empty
    result; columns may have any name.
    """
    sha, high, low, order, maybe = (free_name(docs, n) for n in ("__sha", "__high", "__low", "__order", "__maybe"))
    hashed = docs.withColumn(sha, F.sha2(normalised(text_column), 256))
    halves = lambda df: dict(zip((high, low), _halves(F.col(sha)), strict=True))
    hashes = saved(hashed.select(*[h.alias(n) for n, h in halves(hashed).items()]))
    repeats = RepeatFilter(hashes, max_cells)
    asked = hashed.withColumns(halves(hashed)).withColumn(maybe, repeats.may_repeat(F.col(high), F.col(low)))
    key = F.col(id_column).cast("long")
    best = F.struct(F.length(text_of(text_column)), key.isNotNull(), -F.coalesce(key, F.lit(0)), F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in docs.columns]))
    row = F.struct(*[F.col(c) for c in docs.columns])
    kept = asked.filter(F.col(maybe)).groupBy(sha).agg(F.max_by(row, best).alias(order)).select(f"{order}.*")
    return asked.filter(~F.col(maybe)).select(*docs.columns).unionAll(kept)
