"""Order-preserving packing into token windows by dynamic programming.

Documents of a task stay in their order, end to end, and are cut into windows of
at most ``window`` tokens. Cuts may stand at document ends (free), sentence ends
(SENTENCE_PENALTY) and, inside a sentence of over LONG_SENTENCE tokens only, at
every STEP tokens (HARD_PENALTY); one inside a document that would fit a window
whole costs WHOLE_PENALTY more. The cuts minimise padding plus penalties, which
are in tokens of padding:

    best[j] = penalty[j] + WINDOW_COST + min over i of best[i] + padding(j - i)

where padding is ``window`` minus the length, or 0 at a power of two from 64 on
(shorter windows aren't worth having). The first part of the minimum is a sliding
one, kept in a monotone queue, so a candidate costs constant time; the powers of
two are looked up.

Tasks work independently on blocks of BLOCK tokens or more (whole documents), so
memory is bounded by a block or the longest document, nothing shuffles, and a
task that is run again gives the same windows. Each block loses one window's
padding at most.
"""

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
BLOCK = 1 << 18
SENTENCE_PENALTY, HARD_PENALTY, WHOLE_PENALTY, WINDOW_COST = 16, 48, 64, 32
LONG_SENTENCE, STEP = 96, 8
END_OF_TEXT = "<|endoftext|>"
_TWO_SPACES = re.compile(r"\s\s")


class Tokenizer:
    """The byte-level BPE of ``byte_bpe_50k.json``, read from the same vocabulary as ranks.

    Ids are those of the ``tokenizers`` library on that file, several times faster.
    Where a text has no two white-space characters in a row, the pattern's
    look-ahead can't matter and a plain pattern cuts it alike.
    """

    def __init__(self, ranks_path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {END_OF_TEXT: len(ranks)}
        plain = public_tokenizers.PATTERN.replace(r"|\s+(?!\S)", "")
        self._full = tiktoken.Encoding("full", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._plain = tiktoken.Encoding("plain", pat_str=plain, mergeable_ranks=ranks, special_tokens=special)
        self.ends_sentence = np.zeros(len(ranks) + 1, bool)
        for token, i in ranks.items():
            end = token.rstrip(b" \t\"')")
            self.ends_sentence[i] = end.endswith((b".", b"!", b"?", b"\n"))

    def ids(self, text: str) -> np.ndarray:
        code = self._full if _TWO_SPACES.search(text) else self._plain
        return np.array(code.encode(text, allowed_special="all") if END_OF_TEXT in text else code.encode_ordinary(text), np.uint32)


def choose_cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Window ends out of the candidates ``at``: ascending, none more than ``window``
    after the one before (or 0); the last always is one."""
    cuts, costs = [0, *at.tolist()], [0, *penalty.tolist()]
    powers = [1 << k for k in range(6, window.bit_length() - 1)]
    where = {p: k for k, p in enumerate(cuts)}
    n = len(cuts)
    best, come = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (best + position, index), ascending in both
    for j in range(1, n):
        p = cuts[j]
        while cuts[queue[0][1]] < p - window:
            queue.popleft()
        key, i = queue[0]
        low = key + window - p
        for size in powers:
            k = where.get(p - size)
            if k is not None and best[k] < low:
                low, i = best[k], k
        best[j], come[j] = low + costs[j] + WINDOW_COST, i
        key = best[j] + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], n - 1
    while j:
        out.append(cuts[j])
        j = come[j]
    return out[::-1]


def _candidates(sizes: np.ndarray, sentence_end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places for cuts, penalties) of documents of these token counts, end to end."""
    doc_end = np.cumsum(sizes)
    mark = sentence_end.copy()
    mark[doc_end - 1] = True
    ends = np.flatnonzero(mark) + 1
    begins = np.concatenate([[0], ends[:-1]])
    long = np.flatnonzero(ends - begins > min(LONG_SENTENCE, window // 2))
    inside = np.concatenate([np.empty(0, np.int64), *[np.arange(begins[k] + STEP, ends[k], STEP) for k in long]])
    at = np.concatenate([ends, inside])
    cost = np.concatenate([np.full(len(ends), SENTENCE_PENALTY), np.full(len(inside), HARD_PENALTY)])
    order = np.argsort(at, kind="stable")
    at, cost = at[order], cost[order]
    doc = np.searchsorted(doc_end, at)
    return at, np.where(at == doc_end[doc], 0, cost + WHOLE_PENALTY * (sizes[doc] <= window))


def pack_block(docs: list[np.ndarray], ends_sentence: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, window, offset) of each piece, in order."""
    sizes = np.array([len(d) for d in docs])
    doc_end = np.cumsum(sizes).tolist()
    pieces, d, begin = [], 0, 0
    for w, end in enumerate(choose_cuts(*_candidates(sizes, ends_sentence[np.concatenate(docs)], window), window)):
        p = begin
        while p < end:
            first = doc_end[d] - len(docs[d])
            stop = min(end, doc_end[d])
            pieces.append((d, p - first, stop - p, w, p - begin))
            p = stop
            if p == doc_end[d]:
                d += 1
        begin = end
    return pieces


def _pack(ranks_path: str | None, window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, zero = Tokenizer(ranks_path), np.zeros(1, np.uint32)
        first = TaskContext.get().partitionId() << 40
        names: list[int | None] = []
        docs: list[np.ndarray] = []

        def flush(first: int) -> tuple[pa.RecordBatch, int]:
            pieces = pack_block(docs, tok.ends_sentence, window)
            parts = [docs[d][s : s + n] for d, s, n, _, _ in pieces]
            col = lambda k: pa.array([x[k] for x in pieces], pa.int64())
            out = {"doc_id": pa.array([names[x[0]] for x in pieces], pa.int64()), "start": col(1), "length": col(2), "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in parts], pa.int64()),
                   "doc_tokens": pa.array([len(docs[x[0]]) for x in pieces], pa.int64()), "sequence_id": pa.array([first + x[3] for x in pieces], pa.int64()), "offset": col(4)}
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
                out["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int32)))
            return pa.RecordBatch.from_pydict(out), first + pieces[-1][3] + 1

        held = 0
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                names.append(name.as_py())
                docs.append(np.concatenate([tok.ids(text.as_py() or ""), zero]))
                held += len(docs[-1])
                if held >= BLOCK:
                    out, first = flush(first)
                    yield out
                    names, docs, held = [], [], 0
        if docs:
            yield flush(first)[0]

    return run


def pack(docs: DataFrame, window: int = WINDOW, ranks_path: str | None = None, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Each document's ids and one id 0 after them lie in exactly one piece each;
    offsets in a sequence have no gap. A null or empty text is its id 0 alone.
    Repeated rows are packed each, null ids too; very long texts span as many
    sequences as they need. sequence_id holds the task's number in its high bits. An
    empty table gives an empty result; other columns are not read and may have any
    name. ``window`` must be a power of two, 64 at least.
    """
    if window < 64 or window & (window - 1):
        raise ValueError("window must be a power of two, 64 at least")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(_pack(ranks_path, window, with_ids), schema)
