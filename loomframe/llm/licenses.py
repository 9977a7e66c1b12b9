"""License texts by exact set-similarity join.

A block is a window of consecutive words, WIDTH times as long as a template's
text; it matches a template when it holds at least THRESHOLD of the template's
distinct words.  Templates are whole license texts, notices and their single
sentences.  The search is exact.  All template words are ranked by their
frequency over the whole corpus, rarest first; a match must hold one of the first
``n - need + 1`` words of the template (prefix filter).  These words form an
inverted index, which is as small as the template list and goes to every task.
Texts with fewer words than needed are passed over (length filter).  A hit is
followed up only if its place in both rankings leaves enough (positional
filter): the earlier prefix words around it, itself, and the fewer of the
template's words after it and the words around it that rank after it must reach
the need.  Windows around the hits that are left are counted.

Cases: null counts as empty; empty texts have no words and score 0; rows of a
repeated or null doc_id are scanned one by one; very long texts are scanned
whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least share of a template's distinct words, and window length as a multiple of the template's.
THRESHOLD, WIDTH = 0.8, 1.5

# Phrases whose places are counted, and the label of each.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Sentences of common public licenses and notices, and the label of each.
TEMPLATES = {
    "this work is licensed under the gnu general public license version 3": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
# Whole texts and notices of common public licenses, and the label of each.
TEXTS = {
    """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
    The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
    THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""": "mit",
    """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
    THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""": "isc",
    """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
    THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""": "bsd",
    """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
    Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
    1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
    2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
    3. This notice may not be removed or altered from any source distribution.""": "zlib",
    """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
    Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""": "apache",
    """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
    This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
    You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""": "gpl",
    """This is free and unencumbered software released into the public domain.
    Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""": "unlicense",
}

#: Lower-cases A-Z and turns every byte outside 0-9, a-z and 0x80-0xFF into a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def template_words() -> dict[str, str]:
    """Every template as space-joined words, and its label."""
    return {b" ".join(words_of(t.encode())).decode(): label for t, label in (TEMPLATES | TEXTS).items()}


class Scanner:
    """Templates with their words in global frequency order, and the prefix index."""

    def __init__(self, frequency: dict[str, int], templates: dict[str, str] | None = None, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, width: float = WIDTH):
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        templates = template_words() if templates is None else templates
        every = sorted({w for t in templates for w in t.split()}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w.encode(): i for i, w in enumerate(every)}
        self.templates, self.index = [], {}
        for text, label in templates.items():
            words = text.split()
            order = sorted({self.rank[w.encode()] for w in words})
            need = math.ceil(threshold * len(order) - 1e-9)
            t = len(self.templates)
            self.templates.append((label, order, need, math.ceil(width * len(words))))
            for place in range(len(order) - need + 1):
                self.index.setdefault(order[place], []).append((t, place))
        self.rare = frozenset(w for w, r in self.rank.items() if r in self.index)
        self.hits = self.followed = 0

    def places(self, words: list[bytes]) -> dict[str, list[int]]:
        """Start words of every phrase, by label."""
        joined = b" " + b" ".join(words) + b" "
        out: dict[str, list[int]] = {}
        for phrase, label in self.phrases:
            at, counted, number = joined.find(phrase), 0, 0
            while at >= 0:
                number += joined.count(b" ", counted, at)
                counted = at
                out.setdefault(label, []).append(number)
                at = joined.find(phrase, at + 1)
        return out

    def matches(self, words: list[bytes]) -> dict[str, float]:
        """Best containment of each template's label that meets the threshold."""
        if self.rare.isdisjoint(words):
            return {}
        # places and ranks of all template words in the text
        at = [i for i, w in enumerate(words) if w in self.rank]
        ranks = [self.rank[words[i]] for i in at]
        regions: dict[int, list[tuple[int, int]]] = {}
        for i, r in zip(at, ranks, strict=True):
            for t, place in self.index.get(r, ()):
                _, order, need, width = self.templates[t]
                if len(words) < need:
                    continue
                self.hits += 1
                lo, hi = bisect_left(at, i - width + 1), bisect_left(at, i + width)
                near = set(ranks[lo:hi])
                earlier = sum(x in near for x in order[:place])
                if earlier + 1 + min(len(order) - place - 1, sum(x > r for x in near)) < need:
                    continue
                self.followed += 1
                found = regions.setdefault(t, [])
                if found and lo <= found[-1][1]:
                    found[-1] = (found[-1][0], max(hi, found[-1][1]))
                else:
                    found.append((lo, hi))
        out: dict[str, float] = {}
        for t, found in regions.items():
            label, order, need, width = self.templates[t]
            member = frozenset(order)
            best = max(_most(at[lo:hi], ranks[lo:hi], width, member) for lo, hi in found)
            if best >= need:
                out[label] = max(out.get(label, 0.0), best / len(order))
        return out


def _most(at: list[int], ranks: list[int], width: int, member: frozenset[int]) -> int:
    """Most distinct member words in any window of ``width`` words."""
    held: Counter = Counter()
    best, left = 0, 0
    for i, r in zip(at, ranks, strict=True):
        if r not in member:
            continue
        held[r] += 1
        while at[left] <= i - width:
            gone = ranks[left]
            if gone in held:
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
            left += 1
        best = max(best, len(held))
    return best


def frequencies(docs: DataFrame, templates: dict[str, str] | None = None) -> dict[str, int]:
    """Documents of the whole corpus that hold each template word.

    Only the words of the template list are counted, so a task emits, and the
    driver gets, at most one row for each of them.
    """
    vocabulary = frozenset(w.encode() for t in (template_words() if templates is None else templates) for w in t.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                seen.update(vocabulary.intersection(words_of(t.as_py() or b"")))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(F.col("text").cast("string").cast("binary")).mapInArrow(run, "word string, n long")
    return {r["word"]: int(r["n"]) for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: word counts, phrase places, labels and score.

    ``score`` is 1 where a phrase stands, else the best containment among the
    matching blocks, else 0.
    """
    scanner = Scanner(frequencies(docs, templates), templates, phrases, threshold)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = [c.split()[0] for c in schema.split(", ")]

    def one(text: bytes) -> tuple:
        words = words_of(text)
        places, found = scanner.places(words), scanner.matches(words)
        at = [i for v in places.values() for i in v]
        return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(places)), ",".join(sorted({*places, *found})), 1.0 if at else max(found.values(), default=0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = [one(t.as_py() or b"") for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, schema)
