"""Features recounted plainly, and scores on odd rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm.boosting import BoostedTrees, Isotonic
from quern.llm.toxicity import LEXICON, NEAR, SECOND_PERSON, SUBSTITUTES, Stems, features, score_toxicity

SMALL = "/root/testdata/sf0.001"


def plain(text, stems):
    """Every feature from its description, character by character and word by word."""
    low = text.lower()
    words, word = [], ""
    for c in low + " ":
        if (c.isalpha() or (c.isalnum() and not c.isdecimal())) and re.match(r"[^\W\d_]", c):
            word += c
        elif word:
            words.append(word)
            word = ""
    n = max(len(words), 1)
    bad = [i for i, w in enumerate(words) if w in LEXICON]
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    burst = max((sum(1 for j in bad if i <= j < i + 50) for i in bad), default=0)
    close = sum(any(abs(i - j) <= NEAR for j in you) for i in bad)
    masked = re.findall(r"[a-z]+[0-9@$!|*#.\-_]+[a-z][a-z0-9@$!|*#.\-_]*", low)
    undone = sum(any("".join(c for c in x if "a" <= c <= "z") in LEXICON for x in (m, m.translate(SUBSTITUTES))) for m in masked)
    stretched = len(re.findall(r"([a-z])\1\1+", low))
    data = text.encode("utf-8", "surrogatepass")
    capital, small = sum(65 <= b < 91 for b in data), sum(97 <= b < 123 for b in data)
    marks = sum(32 < b < 127 and not chr(b).isalnum() for b in data)
    weights = [max([0.0, *(stems.weights.get(w[:k], 0.0) for k in range(3, 9))]) for w in words]
    learned = [w for w in weights if w]
    size = max(len(data), 1)
    return [len(bad), 100 * len(bad) / n, len({words[i] for i in bad}), burst, close, 100 * close / n, 100 * len(you) / n, undone, 100 * undone / n, 100 * len(masked) / n, 100 * stretched / n, capital / max(capital + small, 1), marks / size,
            100 * data.count(b"!") / size, 100 * data.count(b"?") / size, np.log1p(len(words)), sum(48 <= b < 58 for b in data) / size, len(learned), 100 * len(learned) / n, sum(learned), 100 * sum(learned) / n, max(learned, default=0.0)]


def test_features_against_a_plain_count(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").join(labels, "doc_id", "left").collect()
    stems = Stems([r.text or "" for r in rows if r.toxic is not None], [r.toxic for r in rows if r.toxic is not None], least=2, odds=0.5)
    texts = [r.text or "" for r in rows] + ["", "!!!", "you IDIOT", "you " * 7 + "idiot", "1d10t id1ot st*pid l0s3r sooooo", "Ünïcode Größe ½ ² ⅷ x", "idiot " * 120 + "you", "\ud800 x", "a_b-c.d"]
    for t in texts:
        assert features(t, stems) == pytest.approx(plain(t, stems)), t[:80]


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(4)
    raw, y = rng.normal(size=300), (rng.random(300) < 0.5).astype(float)
    fit = Isotonic().fit(raw, y)(np.sort(raw))
    assert np.all(np.diff(fit) >= 0)
    order = np.argsort(raw)
    z = y[order]
    # min-max formula of isotonic regression
    best = np.array([max(min(z[a : b + 1].mean() for b in range(k, 300)) for a in range(k + 1)) for k in range(0, 300, 23)])
    assert np.abs(fit[::23] - best).max() < 0.26  # smoothing moves blocks of one the most: by a quarter


def test_trees_find_an_interaction():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.3)).astype(float)
    model = BoostedTrees(rounds=40, depth=3).fit(x[:600], y[:600])
    assert ((model.raw(x[600:]) > 0) == y[600:]).mean() > 0.9


def test_odd_rows_and_clashing_names(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = spark.createDataFrame([(None, None), (None, "x"), (1, ""), (1, "the same text"), (2, "the same text"), (3, "word " * 200_000)], "doc_id long, text string")
    more = docs.select("doc_id", "text").unionAll(rows.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    more = more.withColumn("score", F.lit("x")).withColumn("held_out", F.lit("x")).withColumn("y", F.lit("x"))
    out = score_toxicity(more, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == docs.count() + 6
    got = [(r.doc_id, r.score) for r in out.filter("doc_id > 10000").collect()]
    assert len(got) == 4 and {s for i, s in got if i == 10_002} <= {s for i, s in got if i == 10_001} and all(0 <= s <= 1 for _, s in got)
    assert all(r.held_out for r in out.filter("doc_id is null").collect()) and score_toxicity(more.limit(0), labels).count() == 0
