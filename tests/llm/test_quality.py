"""The byte network against a plain version, and scores that depend on the text alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import quality
from quern.llm.quality import BLOCK, FILTERS, STRIDE, TOPICS, WIDTH, QualityModel, keep_quality, score_quality

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"], 40)) if i % 2 else "".join(rng.choice(list("!?#$ x"), 200)) for i in range(60)]
    return QualityModel(texts, [i % 2 for i in range(60)], 0.5, epochs=4)


def plain(model, text):
    """Window by window, chunk by chunk."""
    p, raw = model.p, text.encode()
    raw = raw.ljust(max(2, -(-len(raw) // BLOCK)) * BLOCK, b"\0")
    filters = []
    for i in range(0, len(raw), STRIDE):
        x = np.zeros((WIDTH, 8))
        for j, b in enumerate(raw[i : i + WIDTH]):
            x[j] = p["e"][b]
        filters.append(np.maximum(x.reshape(-1) @ p["w1"] + p["b1"], 0))
    blocks = np.array(filters).reshape(-1, BLOCK // STRIDE, FILTERS).mean(1)
    top = np.zeros(TOPICS)
    for a, b in zip(blocks[:-1], blocks[1:], strict=True):
        top = np.maximum(top, (a + b) / 2 @ p["w2"] + p["b2"])
    return 1 / (1 + np.exp(-(top @ p["w3"] + p["b3"][0] + model.shift)))


def test_against_the_plain_network(model):
    texts = ["", "a", "lorem ipsum " * 30, "?#!" * 100, "é\0é" * 40, "x" * BLOCK, "y" * (2 * BLOCK + 1)]
    assert model.score(texts) == pytest.approx([plain(model, t) for t in texts], abs=1e-5)


def test_gradients_are_those_of_the_loss(model):
    texts, y = ["lorem ipsum " * 9, "?#! x" * 33, "b" * 50], np.array([1, 0, 1], np.float32)
    shift, model.shift = model.shift, 0.0
    loss = lambda: -np.mean([np.log(p if t else 1 - p) for p, t in zip([plain(model, x) for x in texts], y, strict=True)])
    g = model._gradients(texts, y)
    rng = np.random.default_rng(1)
    for k in ("e", "w1", "b1", "w2", "b2", "w3", "b3"):
        kept = model.p[k]
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in kept.shape) if k != "e" else (rng.choice(list(b"lorem ?#b")), rng.integers(0, 8))
            around = []
            for step in (1e-4, -1e-4):
                model.p[k] = kept.astype(float)
                model.p[k][at] += step
                around.append(loss())
            assert g[k][at] == pytest.approx((around[0] - around[1]) / 2e-4, abs=2e-3)
        model.p[k] = kept
    model.shift = shift


def test_long_texts_are_read_in_pieces(model, monkeypatch):
    text = "".join(np.random.default_rng(3).choice(list("abc ?#"), 40 * BLOCK))
    monkeypatch.setattr(quality, "PIECE", 10 * BLOCK)
    pieces = quality._pieces(text)
    step = quality.PIECE - 2 * BLOCK
    assert len(pieces) > 3 and "".join(p.decode()[:step] for p in pieces[:-1]) + pieces[-1].decode() == text
    alone = [model.score([p.decode()])[0] for p in pieces]
    assert model.score([text])[0] == model.score(["z", text, text])[1] and len(set(alone)) > 1


def test_a_score_depends_on_the_text_alone(spark, model):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    together = model.score(texts)
    assert all(model.score([t])[0] == s for t, s in zip(texts[::7], together[::7], strict=True))
    assert model.score(texts[::-1]).tolist() == together[::-1].tolist()


def test_equal_texts_score_alike(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    more = docs.unionAll(docs.withColumn("doc_id", F.col("doc_id") + 10_000)).repartition(5, "doc_id")
    rows = score_quality(more, labels).join(more.select("doc_id", "text"), "doc_id").collect()
    assert len({(r.text, r.score) for r in rows}) == len({r.text for r in rows})


def test_labels_that_contradict_and_clashing_names(spark):
    """Ids with both labels are left out, so the shares are those of the others."""
    docs = spark.createDataFrame([(i, f"text {i}", 0.5, 1) for i in range(20)] + [(None, None, None, None), (3, "another text of 3", 0.1, 2)], "doc_id long, text string, __score double, y int")
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(i, 0) for i in range(10)], "doc_id long, quality int")
    assert {r.score for r in score_quality(docs, labels).collect()} == {1.0}
    kept = keep_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 22
    assert keep_quality(docs.limit(0), labels).count() == 0
