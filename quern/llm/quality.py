"""Quality by a byte-level convolutional network, written and trained in numpy.

The whole document is read as bytes. Each byte has a learned embedding; filters
of WIDTH bytes at every STRIDE bytes go through a rectifier and are averaged over
chunks of 96 bytes that overlap by half. A second layer of filters over the chunk
is rectified and max-pooled over all chunks of the document; a logistic unit
combines the maxima.

A text's score depends on that text alone: filters end with it, and each layer's
product is taken text by text, for a sum's last bits may depend on the rows
multiplied with it. A text of over PIECE bytes is read in pieces that overlap by
two blocks, so that memory is bounded; a piece's borders are like a text's.

Training uses a bounded sample of labelled rows (``per_class`` of each class, of
any length), outside the held-out fold. Backpropagation passes only through the
chunks that won the maximum. Scoring runs batch by batch; nothing shuffles.
"""

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import free_name
from quern.llm.sample import labelled_sample
from quern.llm.toxicity import scored

WIDTH, STRIDE, BLOCK = 8, 4, 48
EMBED, FILTERS, TOPICS = 8, 24, 16
PER_BLOCK = BLOCK // STRIDE
PIECE = 5000 * BLOCK
GROUP = 1 << 19  # bytes that are worked on at once
BATCH, STEPS = 64, 380  # rows a training step, and the least number of steps


def _pieces(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return [raw[i : i + PIECE] for i in range(0, max(1, len(raw) - 2 * BLOCK), PIECE - 2 * BLOCK)]


def _layout(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all pieces, each zero-padded to two blocks at least; blocks before each piece)."""
    blocks = [max(2, -(-len(r) // BLOCK)) for r in raw]
    return np.frombuffer(b"".join(r.ljust(n * BLOCK, b"\0") for r, n in zip(raw, blocks, strict=True)), np.uint8), np.concatenate([[0], np.cumsum(blocks)])


def _groups(texts: list[str]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(text of each piece, pieces) for about GROUP bytes at a time."""
    owners, raw, size = [], [], 0
    for k, t in enumerate(texts):
        for piece in _pieces(t):
            owners.append(k), raw.append(piece)
            size += len(piece)
            if size >= GROUP:
                yield owners, raw
                owners, raw, size = [], [], 0
    if raw:
        yield owners, raw


def _by_piece(x: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``x @ w``, a product for each piece."""
    out = np.empty((len(x), w.shape[1]), np.float32)
    for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        np.matmul(x[i:j], w, out=out[i:j])
    return out


class QualityModel:
    def __init__(self, texts: list[str], labels: list[int], share: float, epochs: int = 10, rate: float = 0.01, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"e": init(256, EMBED) * 4, "w1": init(WIDTH * EMBED, FILTERS), "b1": np.zeros(FILTERS, np.float32), "w2": init(FILTERS, TOPICS), "b2": np.full(TOPICS, 0.1, np.float32), "w3": init(TOPICS, 1)[:, 0], "b3": np.zeros(1, np.float32)}
        y = np.array(labels, np.float32)
        known = len(y) and y.min() != y.max()
        sampled = float(y.mean()) if len(y) else 0.5
        self.shift = np.log(share / (1 - share)) - np.log(sampled / (1 - sampled)) if known and 0 < share < 1 else 0.0
        self.constant = None if known else share
        if known:
            self._train(texts, y, epochs, rate, rng)

    def _convolve(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rectified filters at every stride, a row each. A filter is two halves of
        STRIDE bytes; the last row of a piece has the first half alone."""
        half, w = STRIDE * EMBED, self.p["w1"]
        halves = _by_piece(self.p["e"][data].reshape(-1, half), np.concatenate([w[:half], w[half:]], axis=1), starts * PER_BLOCK)
        out = halves[:, :FILTERS] + self.p["b1"]
        halves[starts[1:-1] * PER_BLOCK, FILTERS:] = 0
        out[:-1] += halves[1:, FILTERS:]
        return np.maximum(out, 0, out=out)

    def _chunks(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Features of each chunk (block b and b + 1); the last row of a piece is no chunk."""
        blocks = self._convolve(data, starts).reshape(-1, PER_BLOCK, FILTERS).mean(1)
        return (blocks + np.roll(blocks, -1, axis=0)) / 2

    def _pool(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chunk features, topic activations) with chunks that cross pieces at 0."""
        z = self._chunks(data, starts)
        a = np.maximum(_by_piece(z, self.p["w2"], starts) + self.p["b2"], 0)
        a[starts[1:] - 1] = 0
        return z, a

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        top = np.zeros((len(texts), TOPICS), np.float32)
        for owners, raw in _groups(texts):
            data, starts = _layout(raw)
            np.maximum.at(top, owners, np.maximum.reduceat(self._pool(data, starts)[1], starts[:-1], axis=0))
        logit = (top * self.p["w3"]).sum(1) + self.p["b3"][0] + self.shift
        return 1 / (1 + np.exp(-np.clip(logit.astype(float), -30, 30)))

    def _train(self, texts: list[str], y: np.ndarray, epochs: int, rate: float, rng: np.random.Generator) -> None:
        m, v, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        epochs = max(epochs, -(-STEPS // -(-len(y) // BATCH)))  # small samples are seen more often
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH):
                pick = order[i : i + BATCH]
                g = self._gradients([texts[k] for k in pick], y[pick])
                step += 1
                lr = rate * (1 - 0.8 * epoch / epochs)
                for k in self.p:
                    gk = g[k] + 1e-4 * self.p[k] * (k[0] in "w")
                    m[k] = 0.9 * m[k] + 0.1 * gk
                    v[k] = 0.99 * v[k] + 0.01 * gk * gk
                    self.p[k] = self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)

    def _gradients(self, texts: list[str], y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(texts)
        pieces = [_pieces(t) for t in texts]
        data, starts = _layout([r for x in pieces for r in x])
        z, a = self._pool(data, starts)
        bounds = starts[np.concatenate([[0], np.cumsum([len(x) for x in pieces])])]
        best = np.stack([s + a[s:e].argmax(0) for s, e in zip(bounds[:-1], bounds[1:], strict=True)])  # documents x topics
        top = a[best, np.arange(TOPICS)]
        d = (1 / (1 + np.exp(-np.clip(top @ p["w3"] + p["b3"][0], -30, 30))) - y) / n
        g = {"w3": top.T @ d, "b3": np.array([d.sum()], np.float32)}
        d_top = d[:, None] * p["w3"] * (top > 0)
        rows, at = np.unique(best.ravel(), return_inverse=True)
        d_a = np.zeros((len(rows), TOPICS), np.float32)
        np.add.at(d_a, (at.reshape(best.shape), np.arange(TOPICS)), d_top)
        g["w2"], g["b2"] = z[rows].T @ d_a, d_a.sum(0)
        # Back into the windows of those chunks: two blocks of PER_BLOCK windows each.
        d_conv = (d_a @ p["w2"].T) / (2 * PER_BLOCK)
        window = (rows[:, None] * PER_BLOCK + np.arange(2 * PER_BLOCK)).ravel()
        spots = (window * STRIDE)[:, None] + np.arange(WIDTH)
        seen = np.concatenate([data, np.zeros(WIDTH + 2 * BLOCK, np.uint8)])[np.minimum(spots, len(data) + WIDTH)]
        inside = np.ones((len(window), WIDTH), np.float32)  # what lies behind a piece is not seen
        inside[np.isin(window, starts[1:] * PER_BLOCK - 1), STRIDE:] = 0
        x = (p["e"][seen] * inside[:, :, None]).reshape(len(window), -1)
        d_h = np.repeat(d_conv, 2 * PER_BLOCK, axis=0) * (x @ p["w1"] + p["b1"] > 0)
        g["w1"], g["b1"] = x.T @ d_h, d_h.sum(0)
        d_x = ((d_h @ p["w1"].T).reshape(len(window), WIDTH, EMBED) * inside[:, :, None]).reshape(-1, EMBED)
        g["e"] = np.stack([np.bincount(seen.ravel(), d_x[:, k], 256) for k in range(EMBED)], axis=1).astype(np.float32)
        return g


def _model(docs: DataFrame, labels: DataFrame, per_class: int, id_column: str, text_column: str, label: str):
    return docs.sparkSession.sparkContext.broadcast(QualityModel(*labelled_sample(docs, labels, label, per_class, id_column=id_column, text_column=text_column)))


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1200, threshold: float = 0.3, id_column: str = "doc_id", text_column: str = "text", label: str = "quality") -> DataFrame:
    """One row per row: doc_id, held_out, score, predicted.

    The score is the probability of label 1, by a model fitted on at most
    ``per_class`` labelled rows of each class. Null and empty texts have the score
    of a text without bytes. Equal texts score alike, wherever they stand; a null
    id counts as held out. Without labelled rows of both classes all scores are the
    share of label 1 (0.5 without any). An empty table gives an empty result; only
    the text enters a score, so other columns may have any name.
    """
    model = _model(docs, labels, per_class, id_column, text_column, label)
    return scored(docs, lambda texts: model.value.score(texts), threshold, id_column, text_column)


def keep_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1200, threshold: float = 0.3, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; all columns kept, one pass.

    Scores are those of ``score_quality``: a null or empty text stays or goes by the
    score of a text without bytes, null ids count for nothing, repeated rows stay or
    go together, and without labels of both classes all rows share one score. An
    empty table gives an empty result; columns may have any name.
    """
    import pandas as pd

    model = _model(docs, labels, per_class, id_column, text_column, "quality")

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.score([t or "" for t in texts]))

    name = free_name(docs, "__score")
    return docs.withColumn(name, score(F.col(text_column))).filter(F.col(name) >= threshold).drop(name)
