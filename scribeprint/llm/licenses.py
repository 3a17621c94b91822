"""License scans with a positional index of rare licence words.

The templates are texts of public licences and notices. Of each template the ``RARE_WORDS`` words of highest IDF (document
frequencies are counted over all documents) are indexed with their positions. A file is scanned in this order:

1. Its licence words of highest IDF, those in the index, are looked up. A word at place p of the file that has position q
   in a template proposes that the template starts at p - q.
2. Postings are intersected by relative position: a start is a candidate where ``MIN_RARE`` different rare words (for
   short templates half of theirs) propose starts within ``SPREAD`` of the template's length of each other.
3. The template is aligned with the file there: the heaviest common subsequence of words by IDF. It has to reach
   ``MIN_SCORE`` of the template's weight.
4. Last, the template's mandatory phrase has to stand in that stretch of the file, word for word.

Phrases that are labels by themselves are templates whose mandatory phrase is the whole: their rarest word alone
proposes starts, and all words are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribeprint.llm.scratch import free_name, importable, map_rows, without
from scribeprint.llm.words import MARKS, read_words, runs

# Phrases that are a label wherever they stand.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Texts of public licences and notices. Label, mandatory phrase, text.
NOTICES = (
    ("gpl-notice", "gnu general public license", """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program."""),
    ("lgpl-notice", "gnu lesser general public license", """
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)
any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public
License for more details. You should have received a copy of the GNU Lesser General Public License along with this
library."""),
    ("agpl-notice", "gnu affero general public license", """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License
for more details. You should have received a copy of the GNU Affero General Public License along with this program."""),
    ("apache-notice", "licensed under the apache license", """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("mit-notice", "permission is hereby granted free of charge", """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd-notice", "redistribution and use in source and binary forms", """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc-notice", "permission to use copy modify and or distribute this software", """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""),
    ("zlib-notice", "permission is granted to anyone to use this software for any purpose", """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. If you use this software in a product, an acknowledgment in the product documentation would be
appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution."""),
    ("mpl-notice", "mozilla public license", """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("cc-by-notice", "creative commons attribution", """
This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license,
visit http://creativecommons.org/licenses/by/4.0/."""),
)

#: Words of a template that are looked up, and how many of them have to agree.
RARE_WORDS, MIN_RARE = 16, 5
#: Shares of a template's length: how far starts may lie apart that agree, and what is added on both sides to align.
SPREAD = 0.25
#: Share of a template's IDF weight that must stand in order.
MIN_SCORE = 0.6
ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")


@dataclass
class Template:
    label: str
    base: bool
    words: list[str]
    mandatory: list[str]


def templates() -> list[Template]:
    own = [Template(label, True, phrase.split(), phrase.split()) for phrase, label in PHRASES.items()]
    return own + [Template(label, False, _words(notice), must.split()) for label, must, notice in NOTICES]


def _words(text: str) -> list[str]:
    words = next(read_words(pa.array([text.lower()]), MARKS, fold=True))
    return [words.data[a:b].tobytes().decode() for a, b in zip(words.start, words.end)]


class Index:
    """Postings by word; numbers of words follow their hash."""

    def __init__(self, frequency: np.ndarray | None = None, n_docs: int = 0):
        self.templates = templates()
        names = sorted({w for t in self.templates for w in t.words + t.mandatory})
        first = next(read_words(pa.array([" ".join(names)]), MARKS, fold=True))
        order = np.argsort(first.hashes)
        self.hashes = first.hashes[order]
        self.place = order  # of each number's word in the alphabet
        self.number = {names[k]: n for n, k in enumerate(order)}
        if frequency is None:
            frequency = np.zeros(len(names), np.int64)
        self.idf = np.log((n_docs + 1) / (frequency + 1)) + 1
        self.sequences = [self._numbers(t.words) for t in self.templates]
        self.mandatory = [self._numbers(t.mandatory) for t in self.templates]
        #: Where to start looking for a phrase: at its rarest word.
        self.seed = [int(np.argmax(self.idf[m])) for m in self.mandatory]
        #: By template: its rare words, and how many different ones have to agree.
        self.rare = [self._rarest(s) for s in self.sequences]
        self.need = [min(MIN_RARE, -(-len(r) // 2)) for r in self.rare]
        self.slack = [max(4, int(SPREAD * len(s))) for s in self.sequences]
        # Postings (template, position) of rare words: those of word w are from first[w] to first[w + 1].
        found = sorted((int(w), t, q) for t, s in enumerate(self.sequences) if not self.templates[t].base
                       for q, w in enumerate(s) if w in self.rare[t])
        self.posted = np.array([(t, q) for _, t, q in found], np.int64).reshape(-1, 2)
        self.first = np.searchsorted([w for w, _, _ in found], np.arange(len(self.hashes) + 1))

    def _rarest(self, sequence: np.ndarray) -> np.ndarray:
        """Words of equal IDF in order of the alphabet."""
        words = np.unique(sequence)
        return words[np.lexsort((self.place[words], -self.idf[words]))][:RARE_WORDS]

    def _numbers(self, words):
        return np.array([self.number[w] for w in words])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 if it is in no template."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def phrase_places(self, t: int, numbers: np.ndarray) -> np.ndarray:
        """Places where the mandatory phrase of a template stands whole."""
        phrase, seed = self.mandatory[t], self.seed[t]
        start = np.flatnonzero(numbers == phrase[seed]) - seed
        start = start[(start >= 0) & (start + len(phrase) <= len(numbers))]
        for k, w in enumerate(phrase):
            start = start[numbers[start + k] == w]
        return start

    def proposals(self, numbers: np.ndarray, row: np.ndarray, first: np.ndarray):
        """For each row and template with enough rare words: the row, the template, and the proposed starts in the row
        with the rare words that propose them, by start. Negative starts are before the text."""
        place = np.flatnonzero(numbers >= 0)
        word = numbers[place]
        count = self.first[word + 1] - self.first[word]
        posting = runs(self.first[word], count)
        place, word = np.repeat(place, count), np.repeat(word, count)
        t, q = self.posted[posting].T if len(posting) else (np.empty(0, np.int64),) * 2
        r = row[place]
        start = place - first[r] - q
        order = np.lexsort((word, start, t, r))
        r, t, start, word = r[order], t[order], start[order], word[order]
        cuts = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (t[1:] != t[:-1]))) if len(r) else np.empty(0, np.int64)
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(r)).tolist()):
            if b - a >= self.need[t[a]] and len(np.unique(word[a:b])) >= self.need[t[a]]:
                yield int(r[a]), int(t[a]), start[a:b], word[a:b]

    def candidates(self, t: int, start: np.ndarray, word: np.ndarray) -> list[int]:
        """Starts where enough different rare words agree, those that most agree on first, of these the ones that most
        propose to the word; starts within the slack of one that was taken go with it."""
        ends, same = (np.searchsorted(start, start + s, side="right") for s in (self.slack[t], 0))
        found = [(-n, -len(set(word[k:same[k]].tolist())), int(s)) for k, (s, e) in enumerate(zip(start.tolist(), ends.tolist()))
                 if (not k or s != start[k - 1]) and (n := len(set(word[k:e].tolist()))) >= self.need[t]]
        taken: list[int] = []
        for *_, s in sorted(found):
            if all(abs(s - other) > self.slack[t] for other in taken):
                taken.append(s)
        return taken

    def align(self, t: int, numbers: np.ndarray, start: int) -> float:
        """Share of the template's weight in the heaviest common subsequence with the file near a start; 0 without the
        mandatory phrase there."""
        sequence = self.sequences[t]
        low = max(0, start - self.slack[t])
        part = numbers[low:max(0, start + len(sequence) + 2 * self.slack[t])]
        best = np.zeros(len(part) + 1)
        for w in sequence:
            step = best[:-1] + self.idf[w] * (part == w)
            np.maximum.accumulate(np.maximum(best[1:], step), out=best[1:])
        # Added up in the order of ``best``, so that a share is never more than 1.
        share = float(best[-1] / np.cumsum(self.idf[sequence])[-1])
        return share if share >= MIN_SCORE and len(self.phrase_places(t, part)) else 0.0


PLACES = T.ArrayType(T.StructType([T.StructField("label", T.StringType()),
                                   T.StructField("first_word", T.LongType()),
                                   T.StructField("score", T.DoubleType())]))
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.ArrayType(T.StringType())),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("score", T.DoubleType()), T.StructField("places", PLACES)])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each licence word, and all documents under word -1; one set of rows a task."""
    index = Index()
    size = len(index.hashes)
    count, docs = np.zeros(size, np.int64), 0
    for batch in batches:
        docs += batch.num_rows
        for words in read_words(batch.column(0), MARKS, fold=True):
            numbers = index.numbers(words.hashes)
            hit = numbers >= 0
            pairs = np.unique(words.row[hit] * size + numbers[hit])
            count += np.bincount(pairs % size, minlength=size)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(size), -1)),
                                      pa.array(np.append(count, docs))], names=["word", "n"])


def _scan(batches: Iterator[pa.RecordBatch], statistics, at: int, schema) -> Iterator[pa.RecordBatch]:
    index = Index(*statistics.value)
    for batch in batches:
        out = [[] for _ in RESULT.names]
        for words in read_words(batch.column(at), MARKS, fold=True):
            numbers, row = index.numbers(words.hashes), words.row
            base: dict[int, list[tuple[int, str]]] = {}
            for t, template in enumerate(index.templates):
                if template.base:
                    for p in index.phrase_places(t, numbers).tolist():
                        if row[p] == row[p + len(template.words) - 1]:
                            base.setdefault(int(row[p]), []).append((p - int(words.first[row[p]]), template.label))
            aligned: dict[int, list[tuple[int, str, float]]] = {}
            for r, t, start, word in index.proposals(numbers, row, words.first):
                own = numbers[words.first[r]:words.first[r + 1]]
                for s in index.candidates(t, start, word):
                    if share := index.align(t, own, s):
                        aligned.setdefault(r, []).append((max(s, 0), index.templates[t].label, share))
            for r, n in enumerate(words.counts.tolist()):
                for column, value in zip(out, _row(n, base.get(r, []), aligned.get(r, []))):
                    column.append(value)
        arrays = [pa.array(c, f.type) for c, f in zip(out, list(schema)[-len(out):])]
        yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], schema=schema)


def _row(n_words: int, base: list[tuple[int, str]], aligned: list[tuple[int, str, float]]) -> tuple:
    places = sorted([(p, label, 1.0) for p, label in base] + aligned)
    starts, own = [p for p, _ in base], {label for _, label in base}
    return (n_words, len(base), min(starts, default=None), max(starts, default=None), sorted(own),
            sorted(own | {label for _, label, _ in aligned}), max((s for _, _, s in places), default=0.0),
            [{"label": a, "first_word": p, "score": s} for p, a, s in places])


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with word counts, places and labels of licences.

    ``n_base`` counts all places of the phrases in ``PHRASES``, ``first_word`` and ``last_word``
    are the smallest and largest start among them (null without any), ``labels`` adds
    those of notices, ``score`` is the best share of a template in place, ``places`` lists all.

    Document frequencies are counted over all rows first. Null or empty text has no words and
    no labels. Repeated rows are scanned each by itself, an empty table stays empty, texts are
    read whole, and columns with the names of the result are replaced.
    """
    size = len(Index().hashes)
    importable(docs.sparkSession)
    counted = (docs.select(F.col(text).alias("text")).mapInArrow(_frequencies, "word long, n long")
               .groupBy("word").agg(F.sum("n").alias("n")).collect())  # one row a template word
    frequency, n_docs = np.zeros(size, np.int64), 0
    for r in counted:
        if r["word"] < 0:
            n_docs = r["n"]
        else:
            frequency[r["word"]] = r["n"]
    statistics = docs.sparkSession.sparkContext.broadcast((frequency, n_docs))
    own = text
    if text in ADDED:  # the text is read under another name, and replaced
        own = free_name(docs, "text_")
        docs = docs.withColumnRenamed(text, own)
    base = without(docs, *ADDED)
    schema = T.StructType([*base.schema.fields, *RESULT.fields])
    at = base.columns.index(own)
    found = map_rows(base, lambda b, arrow: _scan(b, statistics, at, arrow), schema)
    return found if own == text else found.drop(own)
