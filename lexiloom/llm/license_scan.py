"""License scans: patience alignment of texts with licence templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import with_columns

WORD = re.compile(r"\w+")
COVERAGE = 0.75
# Notices, headers and texts of public licences; callers may give other templates, such as whole licence files.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-or-later header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "GPL-2.0-or-later header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "AGPL-3.0-or-later header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "LGPL-2.1-or-later header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later "
        "version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        'included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED "
        'BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
        "DAMAGE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of "
        "the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        'without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY '
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
        "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        'provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND '
        "THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in "
        "a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions "
        "must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be "
        "removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the '
        "Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do "
        "so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license "
        "grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and "
        "all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable "
        "object code generated by a source language processor."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means."
    ),
}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        tails[k : k + 1] = [v]
        ends[k : k + 1] = [i]
        back[i] = ends[k - 1] if k else -1
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched places (in text, in template), both increasing. Equal words at either end match; then words that stand
    once in both are anchors, the longest increasing run of them holds, and the gaps between are aligned alike."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, p, q = todo.pop()
        while a < b and p < q and text[a] == template[p]:
            out.append((a, p))
            a, p = a + 1, p + 1
        while a < b and p < q and text[b - 1] == template[q - 1]:
            b, q = b - 1, q - 1
            out.append((b, q))
        if a >= b or p >= q:
            continue
        once = Counter(text[a:b])
        where = {w: k for k, w in enumerate(text[a:b], a)}
        own = Counter(template[p:q])
        anchors = [(where[w], k) for k, w in enumerate(template[p:q], p) if own[w] == 1 and once[w] == 1]
        if not anchors:
            continue
        anchors = [anchors[i] for i in longest_increasing([x for x, _ in anchors])]
        out += anchors
        for (x, k), (y, m) in zip([(a - 1, p - 1), *anchors], [*anchors, (b, q)], strict=True):
            todo.append((x + 1, y, k + 1, m))
    return sorted(out)


def coverage(text: list[str], template: list[str]) -> tuple[float, int, int]:
    """The largest share of the template's words that match within as many words of text as the template has, half as
    many again at most; the first and last place of those."""
    found, best, low = patience(text, template), (0.0, -1, -1), 0
    for high in range(len(found)):
        while found[high][0] - found[low][0] >= 1.5 * len(template):
            low += 1
        share = (high - low + 1) / len(template)
        if share > best[0]:
            best = (share, found[low][0], found[high][0])
    return best


def scan(words: list[str], templates: dict[str, list[str]], least: float) -> list[tuple[str, float, int, int]]:
    """(name, coverage, first, last) of every template of which some place in the text covers at least ``least``.

    A template is tried in windows of three times its length, half its length apart, wherever enough of its words are;
    fewer can't cover enough. In a window words that repeat elsewhere are unique. Words around a template can hide an
    anchor from one window, and then the next ones see it among other words; what no window's anchors align isn't found.
    """
    have, out = set(words), []
    for name, template in templates.items():
        sizes = Counter(template)
        if sum(n for w, n in sizes.items() if w in have) < least * len(template):
            continue
        n, best = len(template), (0.0, -1, -1)
        half = max(1, n // 2)
        hits = [i for i, w in enumerate(words) if w in sizes]
        for start in sorted({k * half for b in {i // half for i in hits} for k in range(max(0, b - 3 * n // half + 1), b + 1)}):
            low, high = bisect_left(hits, start), bisect_left(hits, start + 3 * n)
            if high - low < least * n:
                continue
            share, first, last = coverage(words[start : start + 3 * n], template)
            if share > best[0]:
                best = (share, start + first, start + last)
        if best[0] >= least:
            out.append((name, *best))
    return sorted(out, key=lambda x: (-x[1], -len(templates[x[0]]), x[0]))


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = COVERAGE) -> DataFrame:
    """Adds found to each row of docs (doc_id, text; other columns stay, found is replaced): an array of license,
    coverage, first and last (places of words), best first, for each template that the whole text covers.

    Words are runs of letters, digits and _, in lower case. Null and empty texts and templates without words give
    nothing. Every row is looked at by itself, so copies, repeated rows and null ids are no matter. Very long texts are
    held as words, one text at a time.
    """
    own = {name: w for name, t in (TEMPLATES if templates is None else templates).items() if (w := words_of(t))}

    def make():
        names = ("license", "coverage", "first", "last")
        return lambda texts: [[[dict(zip(names, x, strict=True)) for x in scan(words_of(t), own, least)] for t in texts]]

    return with_columns(docs, {"found": "array<struct<license:string,coverage:double,first:long,last:long>>"}, make)


def query(docs: DataFrame) -> DataFrame:
    """doc_id, license (null: none), coverage, first, last and n_licenses for every document."""
    found = licenses(docs.select("doc_id", "text"))
    best = F.get("found", F.lit(0))
    return found.select(
        "doc_id", best["license"].alias("license"), F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"),
        best["first"].alias("first"), best["last"].alias("last"), F.size("found").alias("n_licenses"),
    )
