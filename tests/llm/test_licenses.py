"""Labels and scores against brute force over every place of every key phrase."""

import random

import pytest
from pyspark.sql import functions as F

from quern.llm.license_scan import BASE_PHRASES, TEMPLATES, scan_licenses, words_of

SMALL = "/root/testdata/sf0.001"


def brute(text, templates):
    """(labels, score): a template counts wherever its key phrase stands."""
    w = words_of(text or "")
    labels = {label for p, label in BASE_PHRASES.items() if any(w[i : i + len(p.split())] == p.split() for i in range(len(w)))}
    score = 1.0 if labels else 0.0
    for label, notice, phrase in templates:
        n, p = words_of(notice), words_of(phrase)
        at = next(i for i in range(len(n)) if n[i : i + len(p)] == p)
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                labels.add(label)
                off = i - at
                score = max(score, sum(0 <= off + k < len(w) and w[off + k] == x for k, x in enumerate(n)) / len(n))
    return ",".join(sorted(labels)), score


def texts():
    rng = random.Random(3)
    out = [None, "", "mozilla public license", "cc0 1 0", "the mit license", "The MIT of license", "MIT License the"]
    for _, notice, phrase in TEMPLATES:
        w = words_of(notice)
        out += [notice, "x y " + notice + " z", phrase, " ".join(w[3:]), " ".join(w[:-2]), notice.upper() + " " + notice]
        for _ in range(6):
            v = [x if rng.random() > 0.1 else rng.choice(w) for x in w]
            out.append(" ".join([*rng.sample(w, min(3, len(w))), *v, *rng.sample(w, min(5, len(w)))]))
    return out


def check(spark, rows, templates=None):
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("words", F.lit("clash")).withColumn("votes", F.lit("clash"))
    got = {r.doc_id: (r.labels, r.score) for r in scan_licenses(docs, templates=templates).collect()}
    for i, t in enumerate(rows):
        labels, score = brute(t, TEMPLATES if templates is None else templates)
        assert got[i] == (labels, pytest.approx(score)), t


def test_templates_against_brute_force(spark):
    check(spark, texts() + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()])


def test_five_hundred_long_templates(spark):
    rng = random.Random(7)
    common = [f"w{i}" for i in range(400)]
    templates = []
    for t in range(500):
        words = [rng.choice(common) for _ in range(600)] + [f"own{t}"] + [rng.choice(common) for _ in range(600)]
        at = rng.randrange(1, 1150)
        templates.append((f"l{t}", " ".join(words), " ".join(words[at : at + rng.randrange(1, 9)])))
    templates.append(("one", "word", "word"))
    rows = [templates[3][1], "pre " + templates[77][1] + " post", templates[9][2], "a word here", "nothing", " ".join(rng.choice(common) for _ in range(3000))]
    check(spark, rows, templates)


def test_odd_templates(spark):
    docs = spark.createDataFrame([(1, "cc by"), (None, None)], "doc_id long, text string")
    assert {(r.doc_id, r.labels, r.score) for r in scan_licenses(docs, templates=[]).collect()} == {(1, "cc-by", 1.0), (None, "", 0.0)}
    for phrase in ("not in it", "", "..."):
        with pytest.raises(ValueError):
            scan_licenses(docs, templates=[("x", "a notice", phrase)])
    assert scan_licenses(docs.limit(0)).count() == 0


def test_literals_are_folded(spark):
    plan = scan_licenses(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "cast(split" not in plan and plan.count("split(") <= 2  # a verified notice alone is split by row
