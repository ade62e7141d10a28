"""License scans: texts are held against license templates by patience alignment."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import as_bytes, importable

#: Share of a template's words that a passage must hold in order, and of the passage's words that must be the template's.
COVERAGE, DENSITY = 0.8, 0.6

#: What disclaims in the MIT license and in the two BSD licenses. Fixed values, as published.
_MIT_END = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_END = ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_IF = ", provided that the above copyright notice and this permission notice appear in all copies."

#: Notices, grants and full texts of well-known public licenses, as they are published:
#: (license, text, words that must be found in their places, words that a passage must not hold).
#: The last two tell a license from those whose words are nearly the same.
TEMPLATES: list[tuple[str, ...]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2 0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', "apache 2 0"),
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", _MIT),
    ("MIT", f"{_MIT} {_MIT_END}"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu 3", "lesser affero"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu 2", "lesser affero"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu 3", "lesser affero"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gnu 2", "lesser affero"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4 0", "nc sa nd"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by sa 4 0", "nc nd"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by nc 4 0", "sa nd"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", "cc by nc sa 4 0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "commons attribution 4 0", "noncommercial sharealike noderivatives"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", _BSD_TWO + _BSD_END, "", "neither endorse"),
    ("BSD-3-Clause", _BSD_TWO + _BSD_THIRD + _BSD_END, "neither endorse promote"),
    ("ISC", _ISC + _ISC_IF, "appear"),
    ("ISC", _ISC + _ISC_IF + _ISC_END, "appear"),
    ("0BSD", f"{_ISC}.{_ISC_END}", "", "appear"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mozilla 2 0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.'),
]

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def license_words(text: bytes | str | None) -> list[bytes]:
    """Words in lower case, without punctuation: what differs in layout alone is equal."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return _WORD.findall(raw.lower())


def longest_increasing(values: Sequence[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting: O(n log n)."""
    tops, piles, back = [], [], []
    for i, v in enumerate(values):
        k = bisect.bisect_left(tops, v)
        back.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v), piles.append(i)
        else:
            tops[k], piles[k] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _common(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """A longest common subsequence, where no word is unique to both."""
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        row = np.where([a[i] == y for y in b], best[i + 1, 1:] + 1, best[i + 1, :-1])
        best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Pairs (i, j) of equal words, increasing in both, by patience alignment.

    Equal ends are taken first. Words that occur once in a and once in b are candidates for
    anchors; of these the longest increasing subsequence holds, and the gaps between anchors are
    aligned in the same way. A gap without such a word gets a longest common subsequence.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        at_a, at_b = {}, {}
        for at, words, x, z in ((at_a, a, a0, a1), (at_b, b, b0, b1)):
            for i in range(x, z):
                at[words[i]] = -1 if words[i] in at else i
        unique = [(i, at_b[w]) for w, i in at_a.items() if i >= 0 and at_b.get(w, -1) >= 0]
        if not unique:
            if not at_a.keys().isdisjoint(at_b):
                out += [(a0 + i, b0 + j) for i, j in _common(a[a0:a1], b[b0:b1])]
            continue
        unique.sort()
        anchors = [unique[k] for k in longest_increasing([j for _, j in unique])]
        out += anchors
        x, y = a0, b0
        for i, j in [*anchors, (a1, b1)]:
            todo.append((x, i, y, j))
            x, y = i + 1, j + 1
    return sorted(out)


class Scanner:
    """Templates as numbers of words, for one process."""

    def __init__(self, templates: Sequence[tuple[str, ...]], coverage: float = COVERAGE, density: float = DENSITY) -> None:
        self.coverage, self.density = coverage, density
        self.vocabulary: dict[bytes, int] = {}
        self.templates = []
        self.telling: list[tuple[set[int], set[int]]] = []  # words that must be aligned, words that must not be there
        number = lambda words: [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in license_words(words)]
        for k, (name, text, *telling) in enumerate(templates):
            if ids := number(text):
                self.templates.append((k, name, ids))
                must, never = (set(number(x)) for x in [*telling, "", ""][:2])
                self.telling.append((must, never))
        self.kinds = []
        for _, _, ids in self.templates:
            mine = np.zeros(len(self.vocabulary) + 1, bool)
            mine[ids] = True
            self.kinds.append((mine, len(set(ids))))

    def _passage(self, ids: np.ndarray, where: np.ndarray, a: int, z: int, template: list[int], must: set[int]) -> tuple | None:
        """The aligned passage among words a..z: (matched, first, end); where: their places in the text."""
        pairs = align(ids[a:z].tolist(), template)
        if len(pairs) < self.coverage * len(template) or must and not must <= {template[j] for _, j in pairs}:
            return None
        first, last = where[a + pairs[0][0]], where[a + pairs[-1][0]]
        return (len(pairs), int(first), int(last) + 1) if len(pairs) >= self.density * (last + 1 - first) else None

    def scan(self, words: list[bytes]) -> list[tuple[int, str, int, int, int, float]]:
        """license_words() of a text -> (template, license, first word, end, matched words, coverage) of every passage.

        Passages of one template don't overlap: what covers most stands, then what comes first.
        One that lies in a passage of another license with more matched words doesn't count.
        """
        lookup = self.vocabulary.get
        numbers = np.fromiter((lookup(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(numbers >= 0)
        if not len(known):
            return []
        ids = numbers[known]
        out = []
        present = np.zeros(len(self.vocabulary) + 1, bool)
        present[ids] = True
        for (k, name, template), (mine, kinds), (must, never) in zip(self.templates, self.kinds, self.telling):
            m = len(template)
            need = self.coverage * m
            # At most m - kinds of the template's words repeat another one, so so many kinds must be there.
            if (present & mine).sum() < need - (m - kinds):
                continue
            of = mine[ids]
            some, where = ids[of], known[of]
            reach = int(m / self.density) + 1  # no passage is longer, in words of the text
            found, start = [], 0
            while start < len(some):
                # Blocks of twice the reach, each a reach further on: every passage lies whole in one.
                a = start
                z = int(np.searchsorted(where, where[a] + 2 * reach))
                if z - a >= need and len(np.unique(some[a:z])) >= need - (m - kinds):
                    found += self._inside(some, where, a, z, template, must)
                start = max(a + 1, int(np.searchsorted(where, where[a] + reach))) if z < len(some) else len(some)
            kept = []
            for n, first, end in sorted(set(found), key=lambda x: (-x[0], x[2] - x[1], x[1])):
                if all(end <= f or first >= e for _, f, e in kept) and not (never and never.intersection(numbers[first:end].tolist())):
                    kept.append((n, first, end))
            out += [(k, name, first, end, n, n / m) for n, first, end in kept]
        # A passage that lies in another license's, which matches more words, is a part of that license.
        inner = lambda x: any(y[1] != x[1] and y[4] > x[4] and y[2] <= x[2] and x[3] <= y[3] for y in out)
        return sorted((x for x in out if not inner(x)), key=lambda x: (x[2], x[3], x[0]))

    def _inside(self, some: np.ndarray, where: np.ndarray, a: int, z: int, template: list[int], must: set[int]) -> list[tuple]:
        """Passages in a block. A notice that stands there twice hides its words from each other, so halves are tried too."""
        out, todo, m = [], [(a, z)], len(template)
        while todo:
            x, y = todo.pop()
            if y - x < self.coverage * m:
                continue
            if hit := self._passage(some, where, x, y, template, must):
                out.append(hit)
                i, j = np.searchsorted(where, [hit[1], hit[2]])
                todo += [(x, int(i)), (int(j), y)]  # another may stand before or after it
            elif y - x > m:
                step = max(1, m // 4)
                todo_here = [(s, min(y, s + m + m // 4)) for s in range(x, y - int(self.coverage * m) + 1, step)]
                out += [hit for s, e in todo_here if e - s < y - x and (hit := self._passage(some, where, s, e, template, must))]
        return out


def scan(
    docs: DataFrame, templates: Sequence[tuple[str, ...]] = tuple(TEMPLATES), coverage: float = COVERAGE, density: float = DENSITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, found) of every row: the passages of its whole text that are a template's.

    found lists template (its place in templates), license, first and end (words; end is one past
    the last), matched and coverage, by place in the text. A passage is an alignment that covers
    ``coverage`` of the template's words in order, while ``density`` of its own words are
    aligned; a template's telling words must be among those, and words that tell another license
    must not be in the passage. Templates are a list that one process can hold, and go to all tasks.

    Null and empty texts have no words and nothing found. Rows stay as many as they are, null
    and repeated ids included; equal texts find alike. Texts of any length are read whole, in
    blocks of a few template lengths. Other columns are not looked at.
    """
    importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("template", pa.int32()), ("license", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64())])
    names = [f.name for f in item]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage, density)
        for b in batches:
            texts = as_bytes(b.column(1))
            for i in range(0, len(texts), 1000):
                n_words, found = [], []
                for text in texts[i : i + 1000]:
                    words = license_words(text)
                    n_words.append(len(words))
                    found.append([dict(zip(names, x)) for x in scanner.scan(words)])
                yield pa.RecordBatch.from_arrays([b.column(0)[i : i + 1000], pa.array(n_words, pa.int64()), pa.array(found, pa.list_(item))], ["doc_id", "n_words", "found"])

    return rows.mapInArrow(run, f"doc_id {id_type}, n_words long, found array<struct<template:int,license:string,first:long,end:long,matched:long,coverage:double>>")
