"""Near-duplicate components by min-max hashing.

A document is its set of distinct word shingles. Under each of PERMUTATIONS
random permutations both the smallest and the largest hash are kept, so each
evaluation gives two signature values, each equal between two documents with
probability J, their Jaccard similarity. A band is two permutations (four
values); documents that agree in a band become candidates, and a link counts
only after the full sets are compared.

With 24 bands a pair at J = 0.8 is missed with probability
(1 - 0.8^4)^24 = 3e-6; above it, less.

Scale:
* Documents with the same set collapse first, into their smallest id, before any
  candidate is made: groups of exact copies cost one row.
* In a bucket, members are compared with its smallest id, not with each other:
  first within STAR_ROWS documents of a task, then between these local centres, so
  that a bucket of any size puts one row for so many into the exchange.
* Members that this leaves in another component than their bucket's centre are
  compared with all members of overlapping buckets, block against block, unless
  too few of their shingles occur in any other open member. So no link between
  components is lost, pairs never become rows, and a large connected group is
  compared with its strays only.
* Components come from label propagation in DataFrames; nothing is collected.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.llm.common import components, free_name, saved, small_enough, text_key, text_of

BANDS = 24
BAND_PERMUTATIONS = 2
BLOCK_ROWS = 128
BLOCK_SHINGLES = 1 << 20
STAR_ROWS = 1 << 16  # documents whose bands are held at once
BROADCAST_ROWS = 1_000_000  # ids, 8 bytes each
_RNG = np.random.Generator(np.random.PCG64(20240501))
_A = _RNG.integers(1, 1 << 63, BANDS * BAND_PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * BAND_PERMUTATIONS, dtype=np.uint64)
_BYTES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006  a cache for the process
    """base^0..base^(n-1) modulo 2^64."""
    if base not in known or len(known[base]) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        known[base] = np.multiply.accumulate(out)
    return known[base][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``words`` words.

    A-Z are lower-cased; words are runs without ASCII white space. A text of
    fewer words is one shingle; one without words has none. A shingle's hash is
    a polynomial over its bytes, taken from running sums over the whole text.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(b" ".join(parts), np.uint8)
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(words, len(parts))
    starts, ends = starts[: len(parts) - k + 1], ends[k - 1 :]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(_BASE, len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts]
    return np.unique(_mix(h ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def signature(h: np.ndarray) -> np.ndarray:
    """The band keys of a set: a 64-bit hash of (min, max, min, max) for each band."""
    low, high = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(_A), np.uint64)
    for i in range(0, len(h), 2048):
        x = h[None, i : i + 2048] * _A[:, None] + _B[:, None]
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    values = np.stack([low, high], axis=1).reshape(BANDS, 2 * BAND_PERMUTATIONS)
    key = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for j in range(values.shape[1]):
        key = _mix(key ^ values[:, j]) + np.uint64(j)
    return key.view(np.int64)


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, s1, s2, bands = [], [], [], []
            for text in batch.column(1):
                h = shingle_hashes(text.as_py(), words)
                a, b = np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), np.int64)
                sizes.append(len(h)), s1.append(int(a)), s2.append(int(b)), bands.append(signature(h) if len(h) else None)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "t1": batch.column(2), "t2": batch.column(3), "n_shingles": pa.array(sizes, pa.int64()), "s1": pa.array(s1, pa.int64()), "s2": pa.array(s2, pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64()))})

    return run


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, member, centre) within STAR_ROWS documents: each bucket's members point to its smallest id here."""
    ids, keys, held = [], [], 0

    def stars() -> Iterator[pa.RecordBatch]:
        member, band = np.concatenate(ids), np.concatenate(keys)
        order = np.lexsort((member, band))
        member, band = member[order], band[order]
        first = np.r_[True, band[1:] != band[:-1]]
        centre = member[np.flatnonzero(first)][np.cumsum(first) - 1]
        for i in range(0, len(member), 1 << 16):
            yield pa.RecordBatch.from_pydict({"band": band[i : i + (1 << 16)], "member": member[i : i + (1 << 16)], "centre": centre[i : i + (1 << 16)]})

    for batch in batches:
        ids.append(np.repeat(batch.column(0).to_numpy(), BANDS))
        keys.append(batch.column(1).flatten().to_numpy())
        held += batch.num_rows
        if held >= STAR_ROWS:
            yield from stars()
            ids, keys, held = [], [], 0
    if held:
        yield from stars()


def _verify(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x = x.as_py()
                if x != last[0]:
                    last = (x, shingle_hashes(x, words))
                h, g = last[1], shingle_hashes(y.as_py(), words)
                both = len(h) + len(g) - len(np.unique(np.concatenate([h, g])))
                ok.append(100 * both >= percent * (len(h) + len(g) - both) and both > 0)
            yield pa.RecordBatch.from_pydict({"a": batch.column(0), "b": batch.column(1), "ok": pa.array(ok, pa.bool_())})

    return run


class _Links:
    """Compares candidate pairs of representatives on their full sets."""

    def __init__(self, texts: DataFrame, words: int, percent: int):
        self.texts, self.words, self.percent = texts, words, percent

    def of(self, ids: DataFrame) -> DataFrame:
        """The texts of ``ids``: only those move, unless the ids are too many to be broadcast."""
        return self.texts.join(small_enough(saved(ids.distinct()), BROADCAST_ROWS), "id", "left_semi")

    def compare(self, pairs: DataFrame) -> DataFrame:
        """(a, b, ok) for pairs (a, b). Texts meet through exchanges, so a centre with
        many members is split, not gathered."""
        pairs = saved(pairs)
        texts = self.of(pairs.select(F.explode(F.array("a", "b")).alias("id")))
        left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("x")), texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
        rows = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
        return saved(rows.mapInArrow(_verify(self.words, self.percent), "a long, b long, ok boolean"))


    def own_shingles(self, reps: DataFrame) -> DataFrame:
        """(rep, lonely): how many of each representative's shingles no other of ``reps`` has.

        A shingle that all have is aggregated before the exchange to a row a task."""
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, text in zip(batch.column(0), batch.column(1), strict=True):
                    h = shingle_hashes(text.as_py(), words).view(np.int64)
                    yield pa.RecordBatch.from_pydict({"rep": np.full(len(h), name.as_py(), np.int64), "h": h})

        rows = self.of(reps.select(F.col("rep").alias("id"))).mapInArrow(run, "rep long, h long")
        first = rows.groupBy("h").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"))
        return first.filter("rep = last").groupBy("rep").agg(F.count(F.lit(1)).alias("lonely"))

    def across(self, members: DataFrame) -> DataFrame:
        """Links (a, b) between members of different labels, where ``c`` ties members of a bucket.

        Buckets that overlap are one family. A family's members of its commonest
        label need no comparison with each other; the rest are compared with all,
        block against block: a task gets two blocks of about BLOCK_ROWS texts
        (fewer, if they have over BLOCK_SHINGLES shingles together) and counts all
        intersections by a product of their incidence matrices. No pair is a row, and
        links that would close a cycle in a block are left out.
        """
        tied = components(members.filter("rep <> c").select(F.col("rep").alias("a"), F.col("c").alias("b")).distinct())
        rows = saved(members.select("rep", "label", "n").distinct().join(tied, F.col("rep") == F.col("node")).select("rep", "label", "n", F.col("component").alias("family")))
        size = F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)  # in blocks
        sizes = saved(rows.groupBy("family", "label").agg(size.alias("m")))
        families = sizes.groupBy("family").agg(F.max_by("label", F.struct("m", -F.col("label"))).alias("main"), F.max("m").alias("m"), F.sum("m").alias("all"))
        blocks = lambda n: F.ceil(n - 1e-9).cast("int")  # noqa: E731  sums of shares may be off by a rounding
        families = saved(families.select("family", "main", blocks(F.col("m")).alias("bm"), blocks(F.col("all") - F.col("m")).alias("bs")).filter("bs > 0"))
        rows = rows.join(families, "family")
        stray = F.col("label") != F.col("main")
        own = F.when(stray, F.pmod(F.xxhash64("rep"), F.col("bs"))).otherwise(-1 - F.pmod(F.xxhash64("rep"), F.col("bm"))).cast("int")  # main blocks are negative
        rows = rows.select("family", "rep", "label", "bm", "bs", own.alias("own"))
        met = F.when(F.col("own") >= 0, F.sequence(-F.col("bm"), F.col("bs") - 1)).otherwise(F.sequence(F.lit(0), F.col("bs") - 1))
        rows = saved(rows.select("family", "rep", "label", "own", F.explode(met).alias("other")).select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "label", "own"))
        texts = saved(self.of(rows.select(F.col("rep").alias("id"))))
        dealt = rows.join(texts, F.col("rep") == F.col("id")).select("family", "i", "j", "rep", "label", "own", "text")
        return saved(dealt.groupBy("family", "i", "j").applyInPandas(_block_links(self.words, self.percent), "a long, b long").distinct())


def _block_links(words: int, percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["rep", "text"]).sort_values("rep", ignore_index=True)
        sets = [shingle_hashes(t, words) for t in pdf["text"]]
        n = np.array([len(h) for h in sets])
        ids = np.repeat(np.arange(len(sets)), n)
        _, column, count = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True, return_counts=True)
        common = np.cumsum(count > 1) - 1
        keep = count[column] > 1
        ids, column = ids[keep], common[column[keep]]
        order = np.argsort(column, kind="stable")
        ids, column = ids[order], column[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for k in range(0, int(common[-1]) + 1 if len(common) else 0, 4096):
            lo, hi = np.searchsorted(column, [k, k + 4096])
            x = np.zeros((len(sets), 4096), np.float32)
            x[ids[lo:hi], column[lo:hi] - k] = 1
            both += x @ x.T
        both = np.rint(both).astype(np.int64)
        label, own = pdf["label"].to_numpy(), pdf["own"].to_numpy()
        linked = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (both > 0) & (label[:, None] < label[None, :])
        if pdf["i"].iat[0] != pdf["j"].iat[0]:
            linked &= own[:, None] != own[None, :]
        root = {v: v for v in label}

        def find(v):
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        out = []
        for x, y in zip(*np.nonzero(linked), strict=True):
            u, v = find(label[x]), find(label[y])
            if u != v:
                root[v] = u
                out.append((pdf["rep"].iat[x], pdf["rep"].iat[y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def _labelled(df: DataFrame, column: str, labels: DataFrame, out: str) -> DataFrame:
    """``df`` with the component of ``column``: itself unless ``labels`` has it."""
    found = labels.select(F.col("node").alias(column), F.col("component").alias("__c"))
    return df.join(found, column, "left").withColumn(out, F.coalesce("__c", column)).drop("__c")


def _judged(docs: DataFrame, words: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, t1, t2, n_shingles, component_id, kept) for every row; t1 and t2 are its text's key."""
    texts = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    keyed = texts.select("id", "text", *text_key(F.col("text")))
    prints = saved(keyed.mapInArrow(_prints(words), "doc_id long, t1 long, t2 long, n_shingles long, s1 long, s2 long, bands array<long>"))
    reps = saved(prints.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n")).filter("rep is not null"))

    stars = saved(reps.select("rep", "bands").mapInArrow(_local_stars, "band long, member long, centre long"))
    tops = stars.filter("member = centre").withColumn("top", F.min("centre").over(W.partitionBy("band")))  # a row for STAR_ROWS documents of a task at most
    edges = stars.filter("member <> centre").select("band", F.col("centre").alias("a"), F.col("member").alias("b")).unionAll(tops.filter("top <> centre").select("band", F.col("top").alias("a"), F.col("centre").alias("b")))
    edges = saved(edges)

    links = _Links(texts, words, percent)
    tried = links.compare(edges.select("a", "b").distinct())
    labels = components(tried.filter("ok"))
    # Buckets whose star left members in several components.
    open_pairs = tried.filter("not ok")
    left = saved(_labelled(_labelled(open_pairs, "a", labels, "ca"), "b", labels, "cb").filter("ca <> cb").select("a", "b"))
    if not left.isEmpty():
        bands = edges.join(left, ["a", "b"], "left_semi").select("band").distinct()
        members = reps.select("rep", "n", F.explode("bands").alias("band")).join(saved(bands), "band", "left_semi")
        sizes = saved(members.groupBy("band").agg(F.count(F.lit(1)).alias("m")).filter("m > 2"))  # the star of two was their only pair
        members = saved(members.join(sizes, "band").drop("m"))
        # Shingles that no other open member has can't be common to a linked pair: whoever
        # has too many of them is out, and others only meet where the rest may be enough.
        ids = saved(members.select("rep").distinct())
        lonely = saved(links.own_shingles(ids))
        # Of several texts of an id all shingles count, so that none is ruled out by the other's.
        of_id = prints.join(ids, F.col("doc_id") == F.col("rep"), "left_semi").groupBy(F.col("doc_id").alias("rep")).agg(F.sum("n_shingles").alias("total"))
        shared = saved(of_id.join(lonely, "rep", "left").select("rep", (F.col("total") - F.coalesce("lonely", F.lit(0))).alias("u")))
        members = saved(members.join(shared, "rep").filter(F.col("u") * 100 >= F.col("n") * percent))
        now = saved(_labelled(members, "rep", labels, "label"))
        several = saved(now.groupBy("band").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.min("rep").alias("c")).filter("l <> h").select("band", "c"))
        now = saved(now.join(several, "band"))
        if not now.isEmpty():
            labels = components(tried.filter("ok").select("a", "b").unionAll(links.across(now.select("rep", "label", "n", "c"))))

    named = saved(_labelled(reps.select("s1", "s2", F.col("rep")), "rep", labels, "component_id").select("s1", "s2", "component_id"))
    out = prints.select("doc_id", "t1", "t2", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "t1", "t2", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def near_components(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Documents are linked when 100 * |A and B| >= percent * |A or B|; a component
    is named by its smallest doc_id, and that document is the one kept. Texts
    without words (null, empty) are linked with nothing. Rows that share an id
    are one document with either text; a row without an id is never a component's
    name and is kept unless its set equals that of a row with an id. An empty
    table gives an empty result; other columns are not read and may have any name.
    """
    return _judged(docs, words, percent, id_column, text_column).drop("t1", "t2")


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` with one document, the smallest id, of each component; all columns kept.

    The rows that ``near_components`` keeps: rows alike in id and text stay or go
    together, and so do those without an id. An empty table gives an empty result;
    columns may have any name.
    """
    a, b, c = (free_name(docs, n) for n in ("__lost", "__t1", "__t2"))
    lost = saved(_judged(docs, words, percent, id_column, text_column).filter("not kept").select(F.col("doc_id").alias(a), F.col("t1").alias(b), F.col("t2").alias(c)).distinct())
    t1, t2 = text_key(text_of(text_column))
    return docs.join(small_enough(lost, broadcast_rows), F.col(id_column).cast("long").eqNullSafe(F.col(a)) & (t1 == F.col(b)) & (t2 == F.col(c)), "left_anti")
