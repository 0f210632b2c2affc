"""Decontamination against brute force over all windows."""

import random
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from quern.llm.decontaminate import decontaminate, leaks, with_simhash

SMALL = "/root/testdata/sf0.001"


def words(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def grams(w, k):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def brute(docs, items, percent=80, size=5):
    """{(doc, item): (start, words, similarity)}, every window of every document compared with every item."""
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            item = words(item)
            if not item or not w:
                continue
            k = min(size, len(item))
            want, have = Counter(grams(item, k)), grams(w, k)
            m = min(len(item), len(w)) - k + 1
            if m < 1:
                continue
            now, both, best = Counter(), 0, None
            for p, g in enumerate(have):
                both += now[g] < want[g]
                now[g] += 1
                if p >= m:
                    old = have[p - m]
                    now[old] -= 1
                    both -= now[old] < want[old]
                start = p - m + 1
                if start >= 0 and 100 * both >= percent * (m + sum(want.values()) - both):
                    s = both / (m + sum(want.values()) - both)
                    if best is None or s > best[2]:
                        best = (start, m + k - 1, s)
            if best:
                out[d, i] = best
    return out


def found(rows):
    return {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in rows.collect()}


def test_all_windows_of_the_small_tables(spark):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want and found(leaks(docs, items)) == want
    left = {r.doc_id for r in decontaminate(docs, items, broadcast_rows=0).collect()}  # by exchanges
    assert left == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_edited_passages(spark):
    """Swapped halves, insertions, deletions, replacements, trimmed copies, passages at the
    text's ends and in part, a long item, an item that repeats itself, and a hot shingle."""
    rng = random.Random(4)
    item = lambda n, tag: [f"{tag}{j}" for j in range(n)]
    hot = "of the people by the people".split()
    items = [item(50, "a"), item(30, "b"), item(9, "c"), item(3, "d"), item(2000, "e"), ["la", "li"] * 30, [*hot, *item(30, "f")], [*item(30, "g"), *hot], ["one"], item(50, "a")]
    pad = lambda n: [f"x{rng.randrange(10**6)}" for _ in range(n)]
    docs = [[*pad(40), *items[0][25:], *items[0][:25], *pad(40)], [*items[0][25:], *items[0][:25]], ["la", "li"] * 200, [*pad(5), *["la"] * 70], pad(30) + hot * 40 + pad(30), ["one"], pad(3), [*pad(3), "one"], items[0] + items[0][::-1] + items[0]]
    for w in items:
        for _ in range(12):
            t = list(w)
            for _ in range(rng.randrange(1, 2 + len(w) // 25)):
                kind, p = rng.randrange(4), rng.randrange(len(t))
                if kind == 0:
                    t.insert(p, "new")
                elif kind == 1 and len(t) > 1:
                    del t[p]
                elif kind == 2:
                    t[p] = "other"
                else:
                    t = t[rng.randrange(3) :] if rng.random() < 0.5 else t[: len(t) - rng.randrange(3)]
            docs.append([*pad(rng.choice([0, 7, 60])), *t, *pad(rng.choice([0, 7, 60]))])
    docs = [(i, rng.choice([" ", ", ", "  "]).join(d).upper()) for i, d in enumerate(docs)]
    items = [(i, " ".join(w)) for i, w in enumerate(items)]
    want = brute(docs, items)
    got = found(leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert want[0, 0][2] == pytest.approx(42 / 50) and {0, 1} <= {d for d, i in got if i == 9}
    assert got == want


def test_clashing_names_nulls_and_repeated_rows(spark):
    item = " ".join(f"q{i}" for i in range(40))
    items = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (1, item, "y"), (None, item, "y")], "item_id long, text string, h string")
    rows = [(None, item, 1, 2, 3, 4), (1, item, 1, 2, 3, 4), (1, item, 1, 2, 3, 4), (1, "else", 1, 2, 3, 4), (2, None, None, None, None, None), (3, "", 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __t1 long, __T2 long, hs long, spans long")
    assert sorted(((r.doc_id or 0, r.item_id or 0) for r in leaks(docs, items).collect())) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.filter("text is null or text in ('', 'else')").collect()))
    assert decontaminate(docs, items.limit(0)).count() == 6 and decontaminate(docs.limit(0), items).count() == 0
    named = docs.withColumnRenamed("doc_id", "name").withColumnRenamed("text", "body")
    assert leaks(named, items, id_column="name", text_column="body").count() == 4


def test_simhash_of_many_shingles(spark):
    """More than 65,535 shingles, all with a bit set that half of another set lacks."""
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(70_000)), lambda i: F.lit((1 << 63) - 1).cast("long") - F.lit(0).cast("long") * i).alias("all"))
    assert with_simhash(df, "all", "print").first().print == (1 << 63) - 1
