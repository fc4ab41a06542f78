"""License scans by patience alignment.

A text and a template are words in lower case without marks at their ends. Words that occur once in both anchor the
alignment; the longest increasing subsequence of the anchors' places is kept, and the gaps between, before and after
are aligned the same way, after equal words at their ends are taken off. What is scored is the stretch of the text, of at most
``slack`` times the template's length, in which most of the template is matched; coverage is that part of the template.

Templates are notices, file headers and whole licence texts. Many share long parts (a grant and the text that begins with it,
two versions of one header), so of templates covered enough at one place that counts which has most matched words beyond its unmatched
ones: the whole text before its first clause, the right version before the wrong one.

Templates and their rare words are fixed, so a text is aligned only where it has half of a template's rare words, each
such place by itself with enough words on both sides, however long the text is. Where notices follow each other, no word is
there once, so a place that gives nothing is aligned again from each word that the template could begin at. No shuffle.

Edge cases: a null or empty text has no license; of templates of equal score that of the larger coverage, then the first by name, wins; a
null id is passed through; rows that repeat an id are scanned each; a very long text is scanned whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MARKS = ".,;:!?\"'()[]{}<>|*%$&#/\\“”‘’«»"
TEMPLATES = {
    "0bsd-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "agpl-3.0-header": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.',
    "all-rights-reserved": 'All rights reserved.',
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0.',
    "bsd-2-clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-grant": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    "bsl-1.0-text": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    "cc-by-4.0-long": 'licensed under a Creative Commons Attribution 4.0 International License.',
    "cc-by-4.0-notice": 'Licensed under CC BY 4.0.',
    "cc-by-nc-4.0-long": 'licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.',
    "cc-by-nc-4.0-notice": 'Licensed under CC BY-NC 4.0.',
    "cc-by-nc-nd-4.0-long": 'licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.',
    "cc-by-nc-nd-4.0-notice": 'Licensed under CC BY-NC-ND 4.0.',
    "cc-by-nc-sa-4.0-long": 'licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.',
    "cc-by-nc-sa-4.0-notice": 'Licensed under CC BY-NC-SA 4.0.',
    "cc-by-nd-4.0-long": 'licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.',
    "cc-by-nd-4.0-notice": 'Licensed under CC BY-ND 4.0.',
    "cc-by-sa-4.0-long": 'licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.',
    "cc-by-sa-4.0-notice": 'Licensed under CC BY-SA 4.0.',
    "cc0-1.0-long": 'To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.',
    "epl-2.0-header": 'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/',
    "gpl-2.0-header": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.',
    "gpl-3.0-header": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.',
    "gpl-3.0-notice": 'This work is licensed under the GNU General Public License, version 3.',
    "isc-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "lgpl-2.1-header": 'This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.',
    "lgpl-3.0-header": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.',
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mit-notice": 'Released under the MIT License.',
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mpl-2.0-header": 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.',
    "ofl-1.1-notice": 'This Font Software is licensed under the SIL Open Font License, Version 1.1.',
    "ofl-1.1-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software, to use, study, copy, merge, embed, modify, redistribute, and sell modified and unmodified copies of the Font Software, subject to the following conditions: Neither the Font Software nor any of its individual components, in Original or Modified Versions, may be sold by itself. Original or Modified Versions of the Font Software may be bundled, redistributed and/or sold with any software, provided that each copy contains the above copyright notice and this license.',
    "unlicense-text": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.',
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
}
COMMON = frozenset("a all an and any are as at be by either for from if in is it may not of on or see shall the this to under use with without work you your file software version".split())
SCHEMA = "doc_id long, license string, coverage double, first_word int, last_word int, matched int, licenses array<string>"


def normal(text: str) -> list[str]:
    return [w.strip(MARKS).lower() for w in text.split()]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both, by patience."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i >= m or j >= n:
            continue
        in_a, in_b = Counter(a[i:m]), Counter(b[j:n])
        once = {w: k for k, w in enumerate(b[j:n], j) if in_b[w] == 1 and in_a.get(w) == 1}
        if not once:
            continue
        pairs = [(k, once[w]) for k, w in enumerate(a[i:m], i) if w in once]
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for k, (_, y) in enumerate(pairs):
            at = bisect_left(tails, y)
            back.append(ends[at - 1] if at else -1)
            tails[at : at + 1] = [y]
            ends[at : at + 1] = [k]
        chain, k = [], ends[-1]
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        out += chain
        x, y = i, j
        for p, q in [*reversed(chain), (m, n)]:
            if p > x and q > y:
                todo.append((x, p, y, q))
            x, y = p + 1, q + 1
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], least: float, slack: float):
        self.words = {k: normal(v) for k, v in sorted(templates.items())}
        self.least, self.slack = least, slack
        self.rare: dict[str, list[str]] = {}
        self.own = {name: {w for w in ws if w not in COMMON and len(w) > 1} for name, ws in self.words.items()}
        for name, ws in self.own.items():
            for w in ws:
                self.rare.setdefault(w, []).append(name)

    def candidates(self, text: str | None) -> list[tuple[str, int, int, int]]:
        """(license, words matched, first word, last word) of every template that is covered enough, at its best place."""
        words = normal(text or "")
        there = Counter(name for w in self.rare.keys() & set(words) for name in self.rare[w])
        likely = {name for name, n in there.items() if 2 * n >= len(self.own[name])}
        if not likely:
            return []
        spots: dict[str, list[int]] = {}
        for k, w in enumerate(words):
            for name in self.rare.get(w, ()):
                if name in likely:
                    spots.setdefault(name, []).append(k)
        found = []
        for name, at in spots.items():
            template = self.words[name]
            need, reach = len(self.own[name]), int(self.slack * len(template))
            best = (0, 0, 0)
            k = 0
            while k < len(at):
                stop = k
                while stop + 1 < len(at) and at[stop + 1] - at[stop] <= reach:
                    stop += 1
                if 2 * len({words[x] for x in at[k : stop + 1]}) >= need:
                    here = self._place(words, template, max(0, at[k] - reach), min(len(words), at[stop] + reach + 1), reach)
                    if here[0] < self.least * len(template):
                        here = max(here, self._repeated(words, template, at[k : stop + 1]))
                    best = max(best, here)
                k = stop + 1
            if best[0] >= self.least * len(template):
                found.append((name, best[0], -best[1], best[2]))
        return found

    def scan(self, text: str | None) -> tuple:
        """(license, coverage, first word, last word, words matched, all licenses found). Of those that overlap the best counts."""
        found = sorted(self.candidates(text), key=lambda x: (len(self.words[x[0]]) - 2 * x[1], -x[1] / len(self.words[x[0]]), x[0]))
        kept: list[tuple[str, int, int, int]] = []
        for x in found:
            if all(min(x[3], y[3]) - max(x[2], y[2]) + 1 <= 0.5 * min(x[3] - x[2] + 1, y[3] - y[2] + 1) for y in kept):
                kept.append(x)
        if not kept:
            return None, 0.0, None, None, 0, []
        name, matched, first, last = kept[0]
        return name, matched / len(self.words[name]), first, last, matched, sorted(x[0] for x in kept)

    def _repeated(self, words: list[str], template: list[str], at: list[int]) -> tuple[int, int, int]:
        """As ``_place``, of stretches of little more than the template's length from where it could begin."""
        lead = min(k for k, w in enumerate(template) if w not in COMMON and len(w) > 1)
        best = (0, 0, 0)
        for k in at:
            if words[k] == template[lead]:
                a = max(0, k - lead)
                pairs = align(words[a : a + len(template) + len(template) // 4], template)
                if pairs:
                    best = max(best, (len(pairs), -(a + pairs[0][0]), a + pairs[-1][0]))
        return best

    def _place(self, words: list[str], template: list[str], first: int, stop: int, reach: int) -> tuple[int, int, int]:
        """(matched, minus the first word, last word) of the best stretch of words[first:stop]."""
        best = (0, 0, 0)
        step = max(1, reach)
        for a in range(first, stop, step):  # stretches overlap by half, so none is split
            b = min(stop, a + 2 * step)
            pairs = align(words[a:b], template)
            x = 0
            for y in range(len(pairs)):
                while pairs[y][0] - pairs[x][0] >= reach:
                    x += 1
                best = max(best, (y - x + 1, -(a + pairs[x][0]), a + pairs[y][0]))
            if b == stop:
                break
        return best


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, slack: float = 2.0) -> DataFrame:
    """One row per document: its best license, where it stands, and all that are found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates or TEMPLATES, least, slack)
        kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()))
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in batch.column(1)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
