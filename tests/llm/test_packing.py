"""Packing against a plain quadratic program, and ids against the named tokenizer."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import packing
from quern.llm.packing import Tokenizer, choose_cuts, pack, pack_block

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer as Reference

    import public_tokenizers

    return Reference.from_file(public_tokenizers.path("byte_bpe_50k.json")), Tokenizer()


def test_ids_of_odd_texts(both):
    ref, own = both
    for text in ("", "it's  two\n\n spaces ", "a <|endoftext|> b", "  x", "é" * 2000, "x" * 50_000, "   a", "1 2  3", "\x00\x01", "﻿a", "a​b‍", "\r\n\t \x0b\x0c\x1c\x1d\x85 z"):
        assert own.ids(text).tolist() == ref.encode(text, add_special_tokens=False).ids


def test_ids_of_random_texts(both):
    """Control characters, all kinds of white space, contractions, digits, marks and many scripts."""
    ref, own = both
    rng = np.random.default_rng(8)
    sets = ["".join(map(chr, range(33))) + "ab", " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85        　ab1.", "it's we'll I'VE they'Re 'd 'm ", "0123456789٠١२३½²Ⅷ ,.", "abc ABC äöüßéñ çà", "абв где ёж", "漢字 かな カナ 한국어", "עברית العربية", "हिन्दी ก็ไทย", "👍🏽👩‍👩‍👧 🇩🇪 ☃️", "éä̧ ñ", "<|endoftext|> <|a|>", "$€+<=>^`|~ #%&*()[]{}_-"]
    for _ in range(6000):
        letters = list("".join(sets[i] for i in rng.choice(len(sets), rng.integers(1, 4))))
        text = "".join(rng.choice(letters, rng.integers(1, 60)))
        assert own.ids(text).tolist() == ref.encode(text, add_special_tokens=False).ids, repr(text)
    for _ in range(2000):  # any code point
        text = "".join(chr(c) for c in rng.integers(0, 0x110000, 12) if not 0xD800 <= c < 0xE000)
        assert own.ids(text).tolist() == ref.encode(text, add_special_tokens=False).ids, repr(text)


def test_ids_of_the_documents(spark, both):
    ref, own = both
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        assert own.ids(r.text).tolist() == ref.encode(r.text, add_special_tokens=False).ids


def cost(n, penalty, window):
    return (0 if n & (n - 1) == 0 and n >= 64 else window - n) + penalty + packing.WINDOW_COST


@pytest.mark.parametrize("window", [64, 256, 1024])
def test_cuts_are_the_cheapest(window):
    rng = np.random.default_rng(1)
    for _ in range(30):
        at = np.unique(np.cumsum(rng.integers(1, 60, 80)))
        penalty = rng.integers(0, 90, len(at))
        cuts = [0, *at.tolist()]
        best = [0] + [10**9] * len(at)
        for j in range(1, len(cuts)):
            best[j] = min(best[i] + cost(cuts[j] - cuts[i], int(penalty[j - 1]), window) for i in range(j) if cuts[j] - cuts[i] <= window)
        got, last, where = 0, 0, {p: int(c) for p, c in zip(at, penalty, strict=True)}
        for end in choose_cuts(at, penalty, window):
            got, last = got + cost(end - last, where[end], window), end
        assert got == best[-1]


@pytest.mark.parametrize("window", [64, 128, 1024])
def test_blocks_are_covered_in_order(window):
    """Sentences of any length, longer than a window too."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        docs = [rng.integers(0, 50, n).astype(np.uint32) for n in [1, 1, *rng.integers(1, 3000, 12)]]
        ends = np.zeros(50, bool)
        ends[: rng.integers(0, 3)] = True
        pieces = pack_block(docs, ends, window)
        flat, sizes = [], defaultdict(int)
        for d, start, length, w, offset in pieces:
            assert length > 0 and offset == sizes[w]
            sizes[w] += length
            flat += [(d, p) for p in range(start, start + length)]
        assert flat == [(d, p) for d, x in enumerate(docs) for p in range(len(x))]
        assert max(sizes.values()) <= window and list(sizes) == list(range(len(sizes)))


def test_small_windows_and_clashing_names(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("start", F.lit("x")).withColumn("length", F.lit("x"))
    for window in (64, 2048):
        rows = pack(docs, window=window).collect()
        sizes = defaultdict(int)
        for r in rows:
            sizes[r.sequence_id] += r.length
        assert max(sizes.values()) <= window and len({r.doc_id for r in rows}) == docs.count()
    for window in (0, 32, 96):
        with pytest.raises(ValueError):
            pack(docs, window=window)


def test_whole_documents_are_spared():
    """Documents that fit a window are cut less often than by sentences of equal cost."""
    rng = np.random.default_rng(6)
    docs = [np.where(rng.random(n) < 0.05, 1, 0).astype(np.uint32) for n in rng.integers(50, 900, 300)]
    ends = np.array([False, True])
    cut = lambda: len(docs) and sum(1 for p in pack_block(docs, ends) if p[1] > 0)
    spared, kept = cut(), packing.WHOLE_PENALTY
    try:
        packing.WHOLE_PENALTY = 0
        assert spared < cut()
    finally:
        packing.WHOLE_PENALTY = kept
