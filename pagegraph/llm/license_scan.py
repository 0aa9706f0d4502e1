"""Licence scans with a generalised suffix automaton.

One automaton holds the words of all licence templates. A text streams through
it; at each word the automaton gives the longest template substring that ends
there (matching statistics), and its suffix links the longest one of every other
template. Matches that cannot be extended and have at least
`min_match` words are chained per template, in order in both text and template,
at most `max_gap` words of text apart and counted without what they overlap; the
best chain is found by dynamic programming over matches and all their places, and
a template is reported where its best chain covers `min_cover` of its words.

Besides, base phrases are counted exactly, at every word where one starts.

Templates are short notices and whole licence texts; others can be given.

Defined results: null and empty texts have no words, no labels and score 0;
equal texts have equal rows; repeated rows stay; other columns are ignored.
A text of any length is read whole, in one pass, in memory proportional to it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import bounded_batches
from .words import FOLD, texts

#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Licence notices in common use, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated
but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details. You should have received a copy of the GNU General Public License along with this program."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.
We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to
this software under copyright law."""),
)


class SuffixAutomaton:
    """Substrings of several sequences of word ids; each state knows the sequences it occurs in and all places where it ends there."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.places: list[dict[int, set[int]]] = [{}]
        for k, seq in enumerate(sequences):
            last = 0
            for at, w in enumerate(seq):
                last = self._extend(last, w)
                self.places[last].setdefault(k, set()).add(at)
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            up = self.places[self.link[s]]
            for k, at in self.places[s].items():
                up.setdefault(k, set()).update(at)

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.len.append(length)
        self.link.append(link)
        self.places.append({})
        return len(self.len) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The state that holds only q's substrings no longer than p's and one word."""
        short = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = short
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = short
            p = self.link[p]
        return short

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, w)
        new = self._new(self.len[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, w)
        return new

    def matches(self, seq: list[int], least: int) -> Iterator[tuple[int, int, int, int]]:
        """(end, length, sequence, state) of each match of `least` words or more with a sequence that the next word does not extend."""
        state = length = 0
        live: dict[int, tuple[int, int]] = {}
        for at, w in enumerate(seq):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            now: dict[int, tuple[int, int]] = {}
            s, n = state, length
            while n >= least:  # the longest match of every sequence: shorter ones lie up the suffix links
                for k in self.places[s]:
                    if k not in now:
                        now[k] = n, s
                s = self.link[s]
                n = self.len[s]
            for k, (was, before) in live.items():
                if k not in now or now[k][0] != was + 1:
                    yield at, was, k, before
            live = now
        for k, (was, before) in live.items():
            yield len(seq), was, k, before


class Scanner:
    """Base counts, labels, spans and score of one text."""

    def __init__(self, templates=TEMPLATES, base=BASE, min_match: int = 4, min_cover: float = 0.6, max_gap: int = 12):
        self.names = [label for label, _ in templates]
        split = [t.encode().translate(FOLD).split() for _, t in templates]
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for t in split for w in t}))}
        self.sizes = [len(t) for t in split]
        self.automaton = SuffixAutomaton([[self.ids[w] for w in t] for t in split])
        self.base = [(b" " + b" ".join(p.encode().translate(FOLD).split()) + b" ", label) for p, label in base]
        self.least, self.cover, self.gap = min_match, min_cover, max_gap

    def phrases(self, line: bytes) -> tuple[int, int | None, int | None, set[str]]:
        n, starts, labels = 0, [], set()
        for phrase, label in self.base:
            at, word, seen = line.find(phrase), 0, 0
            while at >= 0:
                n += 1
                word += line.count(b" ", seen, at)
                seen = at
                starts.append(word)
                labels.add(label)
                at = line.find(phrase, at + 1)
        return n, min(starts, default=None), max(starts, default=None), labels

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, word after the last, share of the template covered) of the best chain of each template."""
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), dtype=np.int32, count=len(words))
        known = np.concatenate(([0], (ids > 0).view(np.int8), [0]))
        edge = np.flatnonzero(np.diff(known))
        found: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a >= self.least:
                for end, length, k, state in self.automaton.matches(ids[a:b].tolist(), self.least):
                    found.setdefault(k, []).extend((int(a) + end, last + 1, length) for last in sorted(self.automaton.places[state][k]))
        out = []
        for k, parts in found.items():
            best, chains = (0, 0, 0), []  # of each match, the most words of a chain that ends with it, and minus its first word
            for i, (end, stop, length) in enumerate(parts):
                chain = (length, length - end)
                for j in range(i - 1, -1, -1):
                    before, until, _ = parts[j]
                    if end - length - before > self.gap:
                        break
                    if (new := length - max(0, before - end + length, until - stop + length)) > 0:
                        chain = max(chain, (chains[j][0] + new, chains[j][1]))
                chains.append(chain)
                best = max(best, (*chain, -end))
            if best[0] >= self.cover * self.sizes[k]:
                out.append((self.names[k], -best[1], -best[2], best[0] / self.sizes[k]))
        return sorted(out)

    def scan(self, text: bytes) -> dict:
        words = text.translate(FOLD).split()
        n, first, last, base = self.phrases(b" " + b" ".join(words) + b" ")
        spans = self.spans(words)
        return {
            "n_words": len(words), "n_base": n, "first_word": first, "last_word": last,
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {s[0] for s in spans})),
            "score": 1.0 if n else max((s[3] for s in spans), default=0.0),
            "spans": [{"label": s[0], "start": s[1], "stop": s[2], "cover": s[3]} for s in spans],
        }


@lru_cache(4)
def _scanner(templates: tuple[tuple[str, str], ...], least: int, cover: float, gap: int) -> Scanner:
    return Scanner(templates, min_match=least, min_cover=cover, max_gap=gap)


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,stop:long,cover:double>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_match: int = 4, min_cover: float = 0.6, max_gap: int = 12, templates: Iterable[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per document, no shuffle: id, counts, labels, score and covered spans. templates: (label, text) pairs."""
    templates = tuple((str(label), str(text)) for label, text in templates)
    bounded_batches(docs.sparkSession)
    kind = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("cover", pa.float64())])))])

    def run(batches):
        scanner = _scanner(templates, min_match, min_cover, max_gap)
        for b in batches:
            rows = pa.Table.from_pylist([scanner.scan(t) for t in texts(b, "text")], schema=kind).combine_chunks()
            for r in rows.to_batches() if b.num_rows else []:
                yield pa.RecordBatch.from_arrays([b.column(0), *r.columns], names=["id", *kind.names])

    few = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return few.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, {COLUMNS}").withColumnRenamed("id", id_col)
