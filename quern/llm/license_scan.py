"""Licence scan by a positional index of rare words, in DataFrame operations alone.

Templates are licence notices and texts. The index holds, for each template, its
RARE words of highest inverse document frequency (taken over the whole corpus) and
the two rarest places of its mandatory key phrase, with their positions. A file's
words that are in the index propose alignments (template, offset); an alignment
that two places agree on (one, for a key phrase of one word) counts when the key
phrase stands there word for word. So a standing key phrase is always found,
whatever the corpus. Base phrases are found everywhere they stand.

All work on a file happens inside its row: nothing shuffles but the counts of the
templates' own words. Templates and postings are four array literals, looked up by
index, so the plan's expressions don't grow with the number of templates.
"""

import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE = 4

#: Fixed values. Base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Fixed values. (label, notice, mandatory key phrase): short notices, then whole licence texts.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2.0", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
        WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE.""", "to deal in the software without restriction"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
        ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
        OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", "distribute this software for any purpose with or without fee"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""", "redistributions of source code must retain the above copyright notice"),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use
        this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must
        not claim that you wrote the original software.""", "to alter it and redistribute it freely"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means.""", "free and unencumbered software released into the public domain"),
]


def words_of(text: str) -> list[str]:
    """A template's words, cut like a file's."""
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def _strings(values: list[str]) -> Column:
    """An array literal of strings without line feeds."""
    return F.split(F.lit("\n".join(values)), "\n")


def _ints(values: list[int]) -> Column:
    return _strings(list(map(str, values))).cast("array<int>")


class _Templates:
    """The templates, and the postings of their indexed places in buckets by crc32 of the word."""

    def __init__(self, templates: list[tuple[str, str, str]]):
        self.labels = [label for label, _, _ in templates]
        self.notices = [words_of(notice) for _, notice, _ in templates]
        self.phrases = [words_of(phrase) for _, _, phrase in templates]
        self.starts = []
        for label, n, p in zip(self.labels, self.notices, self.phrases, strict=True):
            at = next((i for i in range(len(n)) if n[i : i + len(p)] == p), None) if p else None
            if at is None:
                raise ValueError(f"the notice of {label} does not hold its key phrase")
            self.starts.append(at)

    def index(self, counts: dict[str, int]) -> None:
        """Chooses the indexed places by the words' document counts."""
        rarity = lambda w: (counts.get(w, 0), w)
        places = []
        for t, n in enumerate(self.notices):
            rare = set(sorted(dict.fromkeys(n), key=rarity)[:RARE])
            phrase = sorted(range(self.starts[t], self.starts[t] + len(self.phrases[t])), key=lambda i: rarity(n[i]))[:2]  # noqa: B023
            places += [(n[i], t, i) for i in sorted({i for i, w in enumerate(n) if w in rare} | set(phrase))]
        self.words = sorted({w for w, _, _ in places})
        self.buckets = 1 << max(1, len(self.words)).bit_length()
        of = lambda w: zlib.crc32(w.encode()) % self.buckets
        places.sort(key=lambda x: (of(x[0]), x))
        sizes = [0] * (self.buckets + 1)
        for w, _, _ in places:
            sizes[of(w) + 1] += 1
        for b in range(self.buckets):
            sizes[b + 1] += sizes[b]
        self._bounds, self._words = _ints(sizes), _strings([w for w, _, _ in places])
        self._templates, self._places = _ints([t for _, t, _ in places]), _ints([i for _, _, i in places])

    def votes(self, hit: Column) -> Column:
        """The alignments that an indexed word (w, i) proposes."""
        bucket = F.pmod(F.crc32(hit["w"].cast("binary")), F.lit(self.buckets)).cast("int")
        at = F.filter(F.sequence(F.get(self._bounds, bucket), F.get(self._bounds, bucket + 1) - 1), lambda k: F.get(self._words, k) == hit["w"])
        return F.transform(at, lambda k: F.struct(F.get(self._templates, k).alias("t"), (hit["i"] - F.get(self._places, k)).alias("off")))

    def verified(self, words: Column, c: Column) -> Column:
        """The key phrase stands at its place of the alignment."""
        first = c["off"] + F.get(_ints(self.starts), c["t"])
        size = F.get(_ints([len(p) for p in self.phrases]), c["t"])
        there = F.array_join(F.slice(words, F.greatest(first, F.lit(0)) + 1, size), " ")
        return (first >= 0) & (there == F.get(_strings([" ".join(p) for p in self.phrases]), c["t"]))

    def share(self, words: Column, c: Column) -> Column:
        """The share of the notice's words that stand at their places."""
        notice = F.split(F.get(_strings([" ".join(n) for n in self.notices]), c["t"]), " ")
        same = F.transform(notice, lambda w, i: F.when((c["off"] + i >= 0) & F.coalesce(F.get(words, F.greatest(c["off"] + i, F.lit(0))) == w, F.lit(False)), 1).otherwise(0))
        return F.aggregate(same, F.lit(0), lambda a, x: a + x) / F.size(notice)


def _same(words: Column, at: Column, phrase: list[str]) -> Column:
    """The phrase stands in ``words`` at the 0-based position ``at``."""
    out = at >= 0
    for i, w in enumerate(phrase):
        out &= F.coalesce(F.get(words, at + i) == w, F.lit(False))
    return out


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan_licenses(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", templates: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """One row per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII
    characters. n_base counts all places of base phrases, first_word and
    last_word their smallest and largest start (null without any). labels joins
    base labels and those of verified templates. score is the largest share of a
    verified template's words that stand at their places, 1 with a base phrase,
    else 0. ``templates``: (label, notice, key phrase), none at all if empty; a key
    phrase that isn't in its notice raises ValueError. Null and empty texts have no
    words and no labels. Repeated rows each give a row, null ids too; an empty table
    gives an empty result; other columns are not read and may have any name.
    """
    known = _Templates(TEMPLATES if templates is None else templates)
    base = [(p.split(), label) for p, label in BASE_PHRASES.items()]
    words = F.regexp_extract_all(F.translate(text_of(text_column), UPPER, LOWER), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col(id_column).alias("doc_id"), words.alias("words"))

    if known.labels:
        # Document counts of the templates' words, over the whole corpus.
        vocabulary = sorted({w for n in known.notices for w in n})
        seen = rows.select(F.explode(F.filter(F.array_distinct("words"), lambda w: w.isin(vocabulary))).alias("w"))
        known.index({r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()})  # no more rows than the vocabulary
    indexed = known.words if known.labels else []
    asked = sorted(set(indexed) | {p[0] for p, _ in base})
    found = rows.withColumn("hits", F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(asked)))
    if known.labels:
        found = found.withColumn("votes", F.array_sort(F.flatten(F.transform(F.filter("hits", lambda h: h["w"].isin(indexed)), known.votes))))
        # Sorted, equal votes stand together: an alignment has two votes if its neighbour is the same.
        single = _ints([int(len(p) == 1) for p in known.phrases])
        found = found.withColumn("agreed", F.array_distinct(F.filter("votes", lambda v, k: F.when(k > 0, F.get(F.col("votes"), k - 1) == v).otherwise(False) | (F.get(single, v["t"]) == 1))))
        found = found.withColumn("sure", F.filter("agreed", lambda c: known.verified(F.col("words"), c)))
        more, share = F.transform("sure", lambda c: F.get(_strings(known.labels), c["t"])), F.coalesce(F.array_max(F.transform("sure", lambda c: known.share(F.col("words"), c))), F.lit(0.0))
    else:
        more, share = F.array().cast("array<string>"), F.lit(0.0)

    def places(phrase: list[str], label: str) -> Column:
        there = F.filter("hits", lambda h: (h["w"] == phrase[0]) & _same(F.col("words"), h["i"], phrase))
        return F.transform(there, lambda h: F.struct(h["i"].alias("i"), F.lit(label).alias("label")))

    found = found.withColumn("base", F.concat(*[places(p, label) for p, label in base]))
    base_labels = F.transform("base", lambda b: b["label"])
    n_base = F.size("base").cast("long")
    return found.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), n_base.alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["i"])).cast("long").alias("first_word"), F.array_max(F.transform("base", lambda b: b["i"])).cast("long").alias("last_word"),
        _joined(base_labels).alias("base_labels"), _joined(F.concat(base_labels, more)).alias("labels"), F.when(n_base > 0, F.lit(1.0)).otherwise(share).alias("score"),
    )
