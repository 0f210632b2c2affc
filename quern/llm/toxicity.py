"""Toxicity by gradient-boosted trees over dense features, calibrated isotonically.

Features count over the whole text: densities of a fixed lexicon, plain and after
undoing character substitutions, and of a lexicon of word stems learned from the
sample (each half's stems serve to train on the other half), closeness of lexicon words to the second person,
capitals, punctuation and obfuscation rates. Texts are scored batch by batch
where they are; nothing shuffles. Training uses a bounded sample (``per_class``
rows of each class) of rows outside the held-out fold, a fifth of it for the
calibration.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.boosting import BoostedTrees, Isotonic
from quern.llm.common import held_out, text_of
from quern.llm.sample import labelled_sample

#: Fixed values. Insults in English, German, French and Spanish.
LEXICON = frozenset(
    """
    bastard clown coward creep cretin degenerate disgusting dumb dumbass filth filthy fool freak garbage gross hate idiot idiotic idiots ignorant imbecile jerk kill liar loser losers lunatic
    maggot moron moronic morons parasite pathetic pig rat retard rubbish scum shit sick slut stupid stupidity suck sucks swine terrible trash ugly useless vermin whore worthless wretch
    abschaum arschloch bastarde blöd dreck drecksau dumm dummkopf ekelhaft hässlich idioten lügner miststück mistkerl nutzlos schwachkopf schwein trottel verlierer widerlich wertlos
    abruti connard crétin débile dégoûtant imbécile inutile laid menteur minable moche ordure perdant pourri raclure répugnant salaud stupide taré vermine
    asqueroso basura cerdo escoria estúpido gilipollas idiota imbécil inútil mentiroso patético perdedor repugnante tarado tonto
    """.split()
)
#: Fixed values. The second person.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton tes vous votre tú ti usted ustedes eres".split())
#: Fixed values. Characters that stand for letters.
SUBSTITUTES = str.maketrans("013457@$!|", "oieastasii")
NEAR = 6
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[a-z]+[0-9@$!|*#.\-_]+[a-z][a-z0-9@$!|*#.\-_]*")
_STRETCHED = re.compile(r"([a-z])\1{2,}")


class Stems:
    """Word beginnings of 3 to 8 letters that toxic texts of the sample use and others don't, with their log odds."""

    SIZES = range(3, 9)

    def __init__(self, texts: list[str], labels: list[int], least: int = 4, odds: float = 2.0, most: int = 2000):
        toxic, clean = Counter(), Counter()
        for text, y in zip(texts, labels, strict=True):
            words = set(_WORD.findall(text.lower()))
            (toxic if y else clean).update({w[:k] for w in words for k in self.SIZES if len(w) >= k})
        n1, n0 = max(sum(labels), 1), max(len(labels) - sum(labels), 1)
        found = {s: float(np.log((c + 0.5) / (n1 + 1) * (n0 + 1) / (clean[s] + 0.5))) for s, c in toxic.items() if c >= least}
        found = sorted(((s, w) for s, w in found.items() if w >= odds), key=lambda x: (-x[1] * toxic[x[0]], x[0]))[:most]
        self.weights = dict(found)
        self._known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        w = self._known.get(word)
        if w is None:
            if len(self._known) > 200_000:
                self._known.clear()
            w = self._known[word] = max((self.weights.get(word[:k], 0.0) for k in self.SIZES), default=0.0)
        return w


def features(text: str, stems: Stems) -> list[float]:
    low = text.lower()
    words = _WORD.findall(low)
    learned = [w for w in map(stems.weight, words) if w]
    n = len(words)
    per = 100.0 / max(n, 1)
    at = [i for i, w in enumerate(words) if w in LEXICON]
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    close = _close(at, you)
    burst = max((np.searchsorted(at, np.array(at) + 50) - np.arange(len(at))).tolist(), default=0)
    masked = _MASKED.findall(low)
    undone = sum(1 for m in masked if re.sub(r"[^a-z]", "", m.translate(SUBSTITUTES)) in LEXICON or re.sub(r"[^a-z]", "", m) in LEXICON)
    stretched = sum(1 for m in _STRETCHED.finditer(low))
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(data, minlength=256)
    size = max(len(data), 1)
    capital, lower = int(kinds[65:91].sum()), int(kinds[97:123].sum())
    marks = int(kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum())
    return [
        float(len(at)), len(at) * per, float(len({words[i] for i in at})), float(burst), float(close), close * per, len(you) * per, float(undone), undone * per, len(masked) * per,
        stretched * per, capital / max(capital + lower, 1), marks / size, kinds[33] / size * 100, kinds[63] / size * 100, float(np.log1p(n)), int(kinds[48:58].sum()) / size,
        float(len(learned)), len(learned) * per, sum(learned), sum(learned) * per, max(learned, default=0.0),
    ]


def _close(at: list[int], you: list[int]) -> int:
    """How many of ``at`` have one of ``you`` within NEAR words."""
    if not at or not you:
        return 0
    a, y = np.array(at), np.array(you)
    k = np.searchsorted(y, a)
    left, right = np.abs(a - y[np.maximum(k - 1, 0)]), np.abs(y[np.minimum(k, len(y) - 1)] - a)
    return int((np.minimum(left, right) <= NEAR).sum())


class ToxicityModel:
    def __init__(self, texts: list[str], labels: list[int], share: float):
        """``share``: of label 1 among all labelled rows; the sample may have another."""
        self.stems = Stems(texts, labels)
        halves = [Stems(texts[k::2], labels[k::2]) for k in (0, 1)]
        x = np.array([features(t, halves[1 - i % 2]) for i, t in enumerate(texts)], float) if texts else np.empty((0, 1))
        y = np.array(labels, float)
        check = np.arange(len(y)) % 5 == 4
        self.trees = BoostedTrees().fit(x[~check], y[~check])
        raw = self.trees.raw(x) if len(y) else np.empty(0)
        # Out-of-sample scores where there are any, so that the map isn't too sure.
        used = check if check.sum() >= 50 and len(set(y[check])) == 2 else np.ones(len(y), bool)
        self.calibration = Isotonic().fit(raw[used], y[used])
        sampled = y.mean() if len(y) else 0.5
        self.odds = (share / (1 - share)) / (sampled / (1 - sampled)) if 0 < share < 1 and 0 < sampled < 1 else 1.0

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        p = np.clip(self.calibration(self.trees.raw(np.array([features(t, self.stems) for t in texts], float))), 0.0, 1.0)
        return p * self.odds / (p * self.odds + 1 - p)


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 1500, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text", label: str = "toxic") -> DataFrame:
    """One row per row: doc_id, held_out, score, predicted.

    The model is fitted on at most ``per_class`` labelled rows of each class. Null
    and empty texts have the score of a text without words. Equal texts score alike;
    a null id counts as held out. Without labelled rows of both classes all scores
    are the share of label 1 (0.5 without any). An empty table gives an empty
    result; only the text enters a score, so other columns may have any name.
    """
    model = docs.sparkSession.sparkContext.broadcast(ToxicityModel(*labelled_sample(docs, labels, label, per_class, id_column=id_column, text_column=text_column)))
    return scored(docs, lambda texts: model.value.score(texts), threshold, id_column, text_column)


def scored(docs: DataFrame, score, threshold: float, id_column: str, text_column: str) -> DataFrame:
    """doc_id, held_out, score and predicted of each row by a function of a list of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "held_out": part.column(1), "score": pa.array(np.asarray(score(part.column(2).to_pylist()), float))})

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out(id_column).alias("held_out"), text_of(text_column).alias("text"))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
