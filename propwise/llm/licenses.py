"""License scan: passages of normalised text against licence templates, by Dice over word bigrams.

``dice = 2 * common / (passage bigrams + template bigrams)``, repeats counted.  A passage of
``s`` bigrams can reach ``threshold`` against a template of ``n`` only if ``s`` lies between
``n * t / (2 - t)`` and ``n * (2 - t) / t`` and shares at least ``n * t / (2 - t)`` bigrams;
templates that a whole text cannot reach by these bounds are dropped before any passage is
looked at.  Passages are runs of words of the whole text that begin and end in a bigram of the
template, the whole text among them.
"""

from __future__ import annotations

import bisect
import heapq
import os
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

THRESHOLD = 0.85
RESULT = ["license", "dice", "first_word", "n_words", "licenses"]

# Public licence notices and short licence texts, by SPDX identifier.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution."""
_BSD_NAMES = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
software for any purpose, including commercial applications, and to alter it and redistribute it freely."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means."""

_ISC_REST = """IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB_REST = """subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not
claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must
not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution."""
_UNLICENSE_REST = """In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and
to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law."""
_GNU_NOTICE = """This {work} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}
General Public License as published by the Free Software Foundation{stop} either version {v} of the License, or (at your option)
any later version. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} General Public License for more
details."""
_GNU_HEAD = """GNU {kind} GENERAL PUBLIC LICENSE Version {v}, {date} Copyright (C) {years} Free Software Foundation, Inc. Everyone
is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."""
#: Identifier, kind, version, date and years of the GNU licences.
_GNU = [
    ("GPL-2.0", "", "2", "June 1991", "1989, 1991"),
    ("GPL-3.0", "", "3", "29 June 2007", "2007"),
    ("LGPL-2.1", "Lesser", "2.1", "February 1999", "1991, 1999"),
    ("LGPL-3.0", "Lesser", "3", "29 June 2007", "2007"),
    ("AGPL-3.0", "Affero", "3", "19 November 2007", "2007"),
]
#: Identifier and spoken names of licences, as single lines name them.
_NAMES = [
    ("MIT", "MIT License"),
    ("ISC", "ISC License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("EPL-2.0", "Eclipse Public License, version 2.0"),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("Zlib", "zlib License"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
]
#: Sentences around such a name; the article goes where the name starts with "CC".
_LINES = ["Released under the {}.", "Licensed under the {}.", "This work is licensed under the {}.",
          "This work is licensed under a {}.", "This project is licensed under the terms of the {}."]


def _named_lines() -> Iterator[tuple[str, str]]:
    for name, spoken in _NAMES:
        for line in _LINES:
            yield name, line.replace("the {}", "{}").replace("a {}", "{}").format(spoken) if spoken.startswith("CC") else line.format(spoken)


def _unique(templates: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Templates that differ in their words, first ones first."""
    found: dict[tuple[str, ...], tuple[str, str]] = {}
    for name, text in templates:
        found.setdefault((name, *words(text)), (name, text))
    return list(found.values())


def built_in() -> list[tuple[str, str]]:
    """``(SPDX identifier, text)``: whole short licences, their first paragraphs, standard notices and heads of long
    ones, lines that name a licence, and identifier tags."""
    whole = [
        ("MIT", _MIT), ("ISC", _ISC), ("ISC", f"{_ISC} {_ISC_REST}"), ("Apache-2.0", _APACHE), ("BSD-2-Clause", _BSD),
        ("BSD-2-Clause", f"{_BSD} {_BSD_REST}"), ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES}"),
        ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES} {_BSD_REST}"), ("MPL-2.0", _MPL), ("Zlib", _ZLIB), ("Zlib", f"{_ZLIB} {_ZLIB_REST}"),
        ("Unlicense", _UNLICENSE), ("Unlicense", f"{_UNLICENSE} {_UNLICENSE_REST}"),
        ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
                    "rights to this work."),
    ]
    for name, kind, v, date, years in _GNU:
        whole += [(name, _GNU_NOTICE.format(kind=kind, v=v, work=work, mark=mark, stop=stop))
                  for work, mark, stop in (("program", ":", ","), ("library", ";", ";"))]
        whole.append((name, _GNU_HEAD.format(kind=kind.upper(), v=v, date=date, years=years)))
    tags = [(name, f"SPDX-License-Identifier: {name}{more}") for name in dict.fromkeys(n for n, _ in [*whole, *_NAMES])
            for more in (["", "-only", "-or-later"] if name in {g[0] for g in _GNU} else [""])]
    return _unique([*whole, *_named_lines(), *tags])


def templates_in(folder: str) -> list[tuple[str, str]]:
    """Templates from files named by SPDX identifier (``MPL-1.1``, ``GPL-2.0.txt``), to be added to ``TEMPLATES``."""
    found = []
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                found.append((name.removesuffix(".txt"), f.read()))
    return found


_WORDS = re.compile(r"[^\W_]+(?:[.\-/][^\W_]+)*")


def words(text: str | None) -> list[str]:
    """Normalised words: lower case, marks dropped, version numbers and hyphenated names whole."""
    return _WORDS.findall((text or "").lower())


TEMPLATES: list[tuple[str, str]] = built_in()


@dataclass
class Template:
    name: str
    bigrams: Counter
    size: int
    least: float  # common bigrams, and bigrams of a passage, at least
    most: float  # bigrams of a passage at most


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = t = threshold
        self.templates = []
        for name, text in templates:
            w = words(text)
            n = len(w) - 1
            self.templates.append(Template(name, Counter(zip(w, w[1:])), n, n * t / (2 - t) - 1e-9, n * (2 - t) / t + 1e-9))
        self.where: dict[tuple[str, str], list[int]] = defaultdict(list)
        for k, x in enumerate(self.templates):
            for b in x.bigrams:
                self.where[b].append(k)

    def best(self, k: int, own: list[tuple[int, tuple[str, str]]], a: int, end: int) -> tuple[float, int] | None:
        """``(dice, bigrams)`` of the best passage for template ``k`` that begins at ``own[a]`` and ends before bigram ``end``."""
        x, found = self.templates[k], None
        first = own[a][0]
        left, common = {}, 0
        most = min(x.most, end - first)
        for p in range(a, len(own)):
            j, b = own[p]
            size = j - first + 1
            if size > most:
                break
            n = left.get(b, x.bigrams[b])
            if n > 0:
                left[b] = n - 1
                common += 1
                if common >= x.least and size >= x.least:
                    got = (2 * common / (size + x.size), size)
                    if got[0] >= self.threshold and (found is None or got > found):
                        found = got
        return found

    def scan(self, text: str | None) -> tuple[str | None, float | None, int | None, int | None, list[str]]:
        """The best licence, its Dice, its passage (first word, words), and all licences found, sorted.

        All passages of all templates count, closest first, unless they overlap a closer one.  Ties go
        to the longer template, then to the earlier passage, then to the name.
        """
        w = words(text)
        where = self.where
        hits = [(i, b) for i, b in enumerate(zip(w, w[1:])) if b in where]
        if not hits:
            return None, None, None, None, []
        shared = Counter(b for _, b in hits)
        common: Counter = Counter()
        for b, n in shared.items():
            for k in where[b]:
                common[k] += min(n, self.templates[k].bigrams[b])
        # for each template and beginning, the best passage that is not known to overlap a closer one
        heap, owns = [], {}

        def add(k: int, a: int, end: int) -> None:
            got = self.best(k, owns[k], a, end)
            if got:
                x = self.templates[k]
                heapq.heappush(heap, (-got[0], -x.size, owns[k][a][0], x.name, -got[1], k, a))

        for k, n in common.items():
            if n >= self.templates[k].least and len(w) - 1 >= self.templates[k].least:
                owns[k] = [h for h in hits if h[1] in self.templates[k].bigrams]
                for a in range(len(owns[k])):
                    add(k, a, len(w))
        kept: list[tuple] = []
        taken: list[tuple[int, int]] = []  # first and last words of the passages kept, in order
        while heap:
            dice, _, first, name, size, k, a = heapq.heappop(heap)
            at = bisect.bisect_right(taken, (first, len(w)))
            if at and taken[at - 1][1] >= first:
                continue  # begins in a closer passage
            if at < len(taken) and taken[at][0] <= first - size:
                add(k, a, taken[at][0] - 1)
                continue
            taken.insert(at, (first, first - size))
            kept.append((dice, name, first, -size))
        if not kept:
            return None, None, None, None, []
        dice, name, first, size = kept[0]
        return name, -dice, first, size + 1, sorted({f[1] for f in kept})


def scan_licenses(docs: DataFrame, text: str = "text", carry: list[str] | None = None,
                  templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` (columns ``carry``, default all) with ``RESULT`` appended.

    Null and empty texts and texts without a licence passage have null results and an empty
    list.  Rows alike get alike results.  Columns of the input that carry a result's name are
    replaced.  The templates are a list that the caller holds, so they are broadcast.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in RESULT]
    rows = docs.select(*carry, F.col(text).cast("string").alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(Scanner(templates, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
        for b in batches:
            got = [sent.value.scan(t) for t in b.column(b.num_columns - 1).to_pylist()]
            cols = [pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], [*b.schema.names[:-1], *RESULT])

    schema = StructType([*rows.schema.fields[:-1], StructField("license", StringType()), StructField("dice", DoubleType()),
                         StructField("first_word", LongType()), StructField("n_words", LongType()),
                         StructField("licenses", ArrayType(StringType()))])
    return rows.mapInArrow(run, schema)
