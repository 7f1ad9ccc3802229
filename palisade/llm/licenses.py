"""License scans: an exact set-similarity join of text blocks with license templates.

For each template a block is any stretch of words of about its notice's length (with room for
a tenth of other words), across lines, so a wrapped notice is found, and words that lie far
apart are none; a template is a notice below.  A block meets a template where it holds at
least ``THRESHOLD`` of the template's distinct words.  Every such pair is found: words are
ordered by their frequency in the corpus (rarest first), and a block that meets the threshold
must hold one of the first |T| - ceil(t|T|) + 1 words of that order (prefix filter; from each of
them ceil(t|T|) words of the order are left, so the positional filter is met by the prefix's
length), and ceil(t|T|) places of the template's words (length filter).  What passes is verified
on whole sets; of all blocks, those that end in a template's word are enough.

The templates are a fixed, short list: they are what is broadcast, and their words are all
that is counted, so nothing grows with the corpus and nothing but counts is shuffled.

Base labels come from phrases whose words stand consecutively in the document, across lines.

Defined results: null and empty texts have no words, no labels and score 0; ``score`` is 1
with a base label, else the best containment of a template met, else 0; templates that are
met alike all give their labels; repeated rows and null doc_ids are scanned row by row; very
long texts are scanned whole; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.kernel import Words, slices

THRESHOLD = 0.9
#: Phrases and labels the contract fixes.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices and paragraphs of licenses by label (fixed values: public license wording).
TEMPLATES = {
    "agpl": ["licensed under the gnu affero general public license"],
    "apache": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or "
        "conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must "
        "reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission",
    ],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a "
        "particular purpose see the gnu general public license for more details",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and "
        "this permission notice appear in all copies",
    ],
    "lgpl": ["licensed under the gnu lesser general public license"],
    "mit": [
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
        "software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
        "particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license"],
    "public-domain": ["this is free and unencumbered software released into the public domain"],
    "reserved": ["all rights reserved no part of this publication may be reproduced"],
}

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True


def hashes_of(text: str) -> np.ndarray:
    return Words(pa.array([text]), WORD_BYTES, lower=True).hashes


class Templates:
    """Templates as sets of word hashes, and the distinct words of them all."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD):
        self.labels, self.sets, self.spans = [], [], []
        for label, notices in templates.items():
            for notice in notices:
                self.labels.append(label)
                words = hashes_of(notice)
                self.sets.append(np.unique(words))
                self.spans.append(math.ceil(len(words) / threshold - 1e-9))
        self.vocabulary = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.least = [math.ceil(threshold * len(s) - 1e-9) for s in self.sets]

    def prefixes(self, frequency: dict[int, int]) -> list[tuple[int, int, int]]:
        """(word, template, place in the global order) of each prefix word."""
        out = []
        for t, words in enumerate(self.sets):
            ordered = sorted(words.tolist(), key=lambda w: (frequency.get(w, 0), w))
            out += [(w, t, i) for i, w in enumerate(ordered[: len(ordered) - self.least[t] + 1])]
        return sorted(out)


def word_counts(docs: DataFrame, templates: Templates) -> dict[int, int]:
    """How often each template word occurs in the corpus: as many rows as templates have words."""
    vocabulary = templates.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(vocabulary), np.int64)
        for part in slices(batches, "text"):
            h = Words(part.column(0), WORD_BYTES, lower=True).hashes
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            n += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["word", "n"])

    if not len(vocabulary):
        return {}
    counted = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {int(vocabulary[r.word]): r.n for r in counted}


class Scanner:
    def __init__(self, templates: Templates, prefixes: list[tuple[int, int, int]], phrases: dict[str, str] = PHRASES):
        self.templates = templates
        self.phrases = [(hashes_of(p), label) for p, label in phrases.items()]
        vocabulary = templates.vocabulary
        self.member = np.array([np.isin(vocabulary, s) for s in templates.sets]).reshape(-1, len(vocabulary))
        self.rare = np.zeros_like(self.member)
        for w, t, _ in prefixes:
            self.rare[t, np.searchsorted(vocabulary, np.uint64(w))] = True

    def stretches(self, words: Words) -> list[tuple[int, int, float]]:
        """(text, template, best containment) where a stretch of the template's span meets it, across lines."""
        vocabulary = self.templates.vocabulary
        if not len(vocabulary) or not words.n:
            return []
        at = np.minimum(np.searchsorted(vocabulary, words.hashes), len(vocabulary) - 1)
        hits = np.flatnonzero(vocabulary[at] == words.hashes)
        kind, doc = at[hits], words.doc[hits]
        found = []
        for t, (whole, least, span) in enumerate(zip(self.templates.sets, self.templates.least, self.templates.spans)):
            able = np.zeros(len(words.counts), bool)
            able[doc[self.rare[t][kind]]] = True
            mine = np.flatnonzero(self.member[t][kind] & able[doc])
            if len(mine) < least:
                continue
            place, word, text = hits[mine], kind[mine], doc[mine]
            start = np.maximum(place - span + 1, words.first[text])
            # The filters: places of the template's words, and of its prefix words, in the stretch that ends here.
            begin, here = np.searchsorted(place, start), np.arange(1, len(mine) + 1)
            rare = np.append(0, np.cumsum(self.rare[t][word]))
            passed = (here - begin >= least) & (rare[here] > rare[begin])
            if not passed.any():
                continue
            common = np.zeros(len(mine), np.int64)
            for w in np.flatnonzero(self.member[t]).tolist():
                common += np.maximum.accumulate(np.where(word == w, place, -1)) >= start  # its last place is in the stretch
            best = np.zeros(len(words.counts), np.int64)
            np.maximum.at(best, text[passed], common[passed])
            found += [(d, t, int(best[d]) / len(whole)) for d in np.flatnonzero(best >= least).tolist()]
        return found

    def __call__(self, text: pa.Array) -> list[pa.Array]:
        words = Words(text, WORD_BYTES, lower=True)
        n = len(text)
        n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        base: list[set[str]] = [set() for _ in range(n)]
        for hashes, label in self.phrases:
            k = len(hashes)
            if words.n < k:
                continue
            same = np.ones(words.n - k + 1, bool)
            for i, h in enumerate(hashes):
                same &= words.hashes[i : words.n - k + 1 + i] == h
            at = np.flatnonzero(same)
            at = at[words.doc[at] == words.doc[at + k - 1]]
            doc = words.doc[at]
            place = at - words.first[doc]
            np.add.at(n_base, doc, 1)
            np.minimum.at(first, doc, place)
            np.maximum.at(last, doc, place)
            for d in np.unique(doc).tolist():
                base[d].add(label)
        score = np.zeros(n)
        labels = [set(b) for b in base]
        for d, t, containment in self.stretches(words):
            labels[d].add(self.templates.labels[t])
            score[d] = max(score[d], containment)
        none = n_base == 0
        score[~none] = 1.0
        return [
            pa.array(words.counts, pa.int64()),
            pa.array(n_base),
            pa.array(first, mask=none),
            pa.array(last, mask=none),
            pa.array([",".join(sorted(b)) for b in base]),
            pa.array([",".join(sorted(b)) for b in labels]),
            pa.array(score),
        ]


NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """Every document with its words, base places, labels and score."""
    rows = docs.selectExpr(f"`{text_col}` AS text", f"`{id_col}` AS doc_id")
    sets = Templates(templates, threshold)
    scanner = Scanner(sets, sets.prefixes(word_counts(rows, sets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(1), *scanner(part.column(0))], names=["doc_id", *NAMES])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
