"""License scans: an exact set-similarity join of text blocks with license templates.

A text is a sequence of words; for each template it is seen as blocks twice the template's length, one from
every word, so that any place up to that length lies within a block wherever it stands. A block meets a
template if it contains at least a given share of the template's distinct words. All words of templates are ordered by how often the whole corpus
has them, rarest first. A block can meet a template only if it holds one of the template's first few words
(prefix filter), has enough words at all (length filter), and enough are left behind the place where the
two first agree (positional filter); what passes is counted out. Where templates of different labels have
most of their words in common, as one license's notice holds another's, the better match of a place counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.runtime import ship

# Phrases that are looked for word for word, and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Further templates, which only the similarity join looks for.
FURTHER = (
    ("licensed under the gnu general public license", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("creative commons attribution noncommercial license", "cc-by-nc"),
    ("creative commons attribution sharealike license", "cc-by-sa"),
)
# Whole license texts and the notices that go into files.
TEXTS = (
    ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
    files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
    merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
    to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
    or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
    BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
    AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
    ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "mit"),
    ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
    that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
    DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
    SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
    OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
    THE USE OR PERFORMANCE OF THIS SOFTWARE.""", "isc"),
    ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
    conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
    disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
    disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor
    the names of its contributors may be used to endorse or promote products derived from this software without specific prior written
    permission.""", "bsd"),
    ("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
    You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
    writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
    either express or implied. See the License for the specific language governing permissions and limitations under the License.""", "apache-2"),
    ("""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
    published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
    distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
    FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
    General Public License along with this program. If not, see http://www.gnu.org/licenses/.""", "gpl"),
    ("""This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
    as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is
    distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
    FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the
    GNU Lesser General Public License along with this library.""", "lgpl"),
    ("""This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License
    as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""", "agpl"),
    ("""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
    this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", "mpl"),
    ("""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
    damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
    commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software
    must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as
    such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source
    distribution.""", "zlib"),
    ("""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
    or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by
    any means.""", "unlicense"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
)
THRESHOLD = 0.8
#: Words that all templates may have together: what is sent to every task.
TEMPLATE_WORDS = 1 << 17
#: Separators become spaces and A-Z become a-z; what is left of a text are its words.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_WORDS).split()


@dataclass(frozen=True)
class Template:
    words: tuple[bytes, ...]
    label: str
    exact: bool
    ranks: tuple[int, ...]  # of its distinct words in the corpus's order, rarest first
    needed: int  # distinct words that a block must have
    rivals: frozenset[str] = frozenset()  # other labels, of templates that share most words with this one

    @cached_property
    def members(self) -> frozenset[int]:
        return frozenset(self.ranks)

    @property
    def prefix(self) -> tuple[int, ...]:
        return self.ranks[: len(self.ranks) - self.needed + 1]


def templates_of(texts: Iterable[tuple[str, str]], exact: bool = False) -> list[tuple[tuple[bytes, ...], str, bool]]:
    """(words, label, exact) of texts; those without a word go."""
    return [(tuple(words), label, exact) for text, label in texts for words in [words_of(text)] if words]


def known_templates() -> list[tuple[tuple[bytes, ...], str, bool]]:
    """The base phrases, and the notices and whole texts that come with the library."""
    return templates_of(BASE, True) + templates_of(FURTHER) + templates_of(TEXTS)


class Scanner:
    """Templates under a global order of words (rarest first)."""

    def __init__(self, counts: dict[bytes, int], threshold: float = THRESHOLD, templates: list[tuple[tuple[bytes, ...], str, bool]] | None = None):
        kinds = known_templates() if templates is None else templates
        vocabulary = sorted({w for words, _, _ in kinds for w in words}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        sets = [frozenset(self.rank[w] for w in words) for words, _, _ in kinds]
        self.templates = []
        for (words, label, exact), own in zip(kinds, sets, strict=True):
            rivals = frozenset(k[1] for k, other in zip(kinds, sets, strict=True) if k[1] != label and len(own & other) >= threshold * min(len(own), len(other)) - 1e-9)
            self.templates.append(Template(words, label, exact, tuple(sorted(own)), math.ceil(threshold * len(own) - 1e-9), rivals))
        self.by_prefix: dict[bytes, list[int]] = {}
        for k, t in enumerate(self.templates):
            for r in t.prefix:
                self.by_prefix.setdefault(vocabulary[r], []).append(k)
        self.openers = frozenset(self.by_prefix)

    def windows(self, words: list[bytes]) -> Iterator[tuple[Template, int, int, float]]:
        """(template, first word, end, containment) of each window that meets a template, from every start."""
        if self.openers.isdisjoint(words):
            return
        near: dict[bytes, list[list[int]]] = {}  # for each template the runs of starts whose windows hold a prefix word
        for at in (i for i, w in enumerate(words) if w in self.openers):
            for k in self.by_prefix[words[at]]:
                runs, lo = near.setdefault(k, []), max(0, at - 2 * len(self.templates[k].words) + 1)
                if runs and lo <= runs[-1][1] + 1:
                    runs[-1][1] = at
                else:
                    runs.append([lo, at])
        for k, runs in near.items():
            for first, last in runs:
                yield from self._slide(self.templates[k], words, first, last)

    def _slide(self, t: Template, words: list[bytes], first: int, last: int) -> Iterator[tuple[Template, int, int, float]]:
        """The windows that start at first to last: counts are kept while the window moves word by word."""
        size = 2 * len(t.words)
        ranks = [self.rank.get(w) for w in words[first : last + size]]
        if len(ranks) < t.needed:  # length filter
            return
        held = {r for r in ranks if r is not None}
        agreed = next(r for r in t.ranks if r in held)
        if sum(r >= agreed for r in held) < t.needed:  # positional filter, for all windows of the run at once
            return
        inside, common, end = dict.fromkeys(t.ranks, 0), 0, 0
        for at in range(last - first + 1):
            while end < min(at + size, len(ranks)):
                r = ranks[end]
                if r in inside:
                    common += inside[r] == 0
                    inside[r] += 1
                end += 1
            if common >= t.needed:
                yield t, first + at, first + end, common / len(t.ranks)
            r = ranks[at]
            if r in inside:
                inside[r] -= 1
                common -= inside[r] == 0

    def blocks(self, words: list[bytes]) -> Iterator[tuple[Template, int, int, float]]:
        """Those of the windows that start on the grid of a template's length and one."""
        return (found for found in self.windows(words) if found[1] % (len(found[0].words) + 1) == 0)

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        labels, places, base, score = set(), set(), set(), 0.0
        contested: list[tuple[int, int, int, Template, float]] = []
        for t, lo, hi, share in self.windows(words):
            if t.rivals:
                matched = [i for i in range(lo, hi) if self.rank.get(words[i], -1) in t.members]
                contested.append((-round(share * len(t.ranks)), matched[-1] + 1 - matched[0], matched[0], t, share))
            else:
                labels.add(t.label)
                score = max(score, share)
            if t.exact and tuple(words[lo : lo + len(t.words)]) == t.words:  # each place starts a window of its own
                places.add((t.words, lo))
                base.add(t.label)
        taken: dict[str, bytearray] = {}  # for each label the words that its matches take
        for _, length, at, t, share in sorted(contested, key=lambda c: c[:3]):  # the most words first, the closest together first
            if not any(1 in taken[r][at : at + length] for r in t.rivals if r in taken):
                taken.setdefault(t.label, bytearray(len(words)))[at : at + length] = b"\1" * length
                score = max(score, share)
        labels |= base | taken.keys()
        starts = [s for _, s in places]
        return {
            "n_words": len(words), "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": max(score, float(bool(places))),
        }


def word_counts(docs: DataFrame, text_col: str = "text", templates: list[tuple[tuple[bytes, ...], str, bool]] | None = None) -> dict[bytes, int]:
    """How often the corpus has each word of a template; tasks add up their own first."""
    ship(docs.sparkSession)
    known = frozenset(w for words, _, _ in (known_templates() if templates is None else templates) for w in words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update(filter(known.__contains__, words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    found = docs.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in found}  # at most one row for each word of a template


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates: DataFrame | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    templates: (text, label), further license texts beside the known ones; all must have TEMPLATE_WORDS words at
    most together, as they go to every task, else this raises. n_base counts all places of base phrases; labels
    also has those of similar blocks, of rivals for a place only the best; score is the largest containment
    among these that reached the threshold, else 0. A null text is an empty one, with no words, empty labels
    and null places; null and repeated ids and repeated rows stay as they are; an empty table gives no rows;
    other columns are not read. Whole texts, of any length, are read twice (counts, then the join) and are never
    shuffled. A block that has a template's words in another order counts like the template.
    """
    kinds = known_templates()
    if templates is not None:
        usable = templates.where("text is not null and label is not null")
        if (usable.agg(F.sum(F.length("text"))).first()[0] or 0) > 16 * TEMPLATE_WORDS:
            raise ValueError("the templates are too large to be sent to every task")
        kinds += templates_of((r["text"], r["label"]) for r in usable.select("text", "label").distinct().collect())
    if sum(len(words) for words, _, _ in kinds) > TEMPLATE_WORDS:
        raise ValueError("the templates are too large to be sent to every task")
    sent = docs.sparkSession.sparkContext.broadcast((word_counts(docs, text_col, kinds), kinds))
    kind = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts, own = sent.value
        scanner = Scanner(counts, threshold, own)
        for texts in batches:
            yield pa.array([scanner.scan(t.as_py()) for t in texts], kind)

    return docs.select(F.col(id_col).alias("doc_id"), scan(F.col(text_col)).alias("s")).select("doc_id", "s.*")
