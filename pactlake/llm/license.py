"""License scan by patience alignment.

The words of a text and of a licence template are aligned: words that occur once in both are anchors, the longest
increasing subsequence of the anchors' positions stays, and the gaps between anchors are aligned the same way, down to
gaps without an anchor, whose equal words at both ends count. Coverage is the share of the template's words aligned.

A text may hold several notices, also the same one twice, so alignment is by window: from a word of the template on, as
many words as the template and its slack have, and twice the template's words; the better of the two counts. Windows are
passed over only where the coverage asked for cannot be reached:

- A coverage c of n words leaves out n - ceil(c n) at most, so of any one word more than that one is in the notice. The
  longest such words of all templates are searched in all texts at once (an Aho-Corasick automaton).
- A window must hold ceil(c n) of the template's words, counted with their repeats (a running count over the text).
- No alignment is longer than the longest common subsequence, which a window that starts s words later exceeds by s at
  most. So a window whose longest common subsequence (by bits, one for each word of the template) lacks s words rules out
  the next s - 1 as well.

Windows are tried from left to right, each once. Where one reaches the coverage, those that start within it are tried
too, the densest is taken (words aligned less words between), and the search goes on behind it. So the time is linear in the
text for a given list of templates. Of notices that overlap the one with more words stays.

One pass without a shuffle. Null texts and texts without a notice get null and 0. Repeated rows get a result each. All
columns are kept, whatever their names; `_notices` (in place of a column of that name) holds license, coverage, start and
end (in characters) of each notice.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")

# Public licence notices and texts by SPDX identifier.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_BOOST = """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"""
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE.split("\n", 1)[0]),
    ("Apache-2.0", _APACHE),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT.split(", including", 1)[0]),
    ("MIT", _MIT),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format(name="General Public License", version="3").split(", or", 1)[0]),
    ("GPL-3.0", _GNU.format(name="General Public License", version="3")),
    ("GPL-2.0", _GNU.format(name="General Public License", version="2")),
    ("LGPL-3.0", _GNU.format(name="Lesser General Public License", version="3")),
    ("AGPL-3.0", _GNU.format(name="Affero General Public License", version="3")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-2-Clause", _BSD_CONDITIONS + "\n" + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD_CONDITIONS.split(":", 1)[0]),
    ("BSD-3-Clause", _BSD_CONDITIONS + "\n" + _BSD_NAMES + "\n" + _BSD_DISCLAIMER),
    ("ISC", _ISC),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("MPL-2.0", _MPL),
    ("BSL-1.0", _BOOST),
    ("Proprietary", "All rights reserved."),
)


def words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by the first) whose second increases."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        j = bisect_left(tails, y)
        tails[j:j + 1] = [y]
        at[j:j + 1] = [k]
        back.append(at[j - 1] if j else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions of two word lists."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        place = {w: p for p, w in enumerate(b[k:m], k) if in_b[w] == 1}
        anchors = increasing([(p, place[w]) for p, w in enumerate(a[i:j], i) if in_a[w] == 1 and w in place])
        out += anchors
        if anchors:
            edges = [(i - 1, k - 1), *anchors, (j, m)]
            todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges[:-1], edges[1:], strict=True) if r - p > 1 and s - q > 1]
    return sorted(out)


def dense(found: tuple[int, int, int]) -> tuple[int, int, int]:
    """What makes a notice (words aligned, first and last word) the better one: words aligned less those between them, then more words, then an earlier place."""
    n, a, b = found
    return 2 * n - (b - a + 1), n, -a


class Template:
    """A licence, its words, how many of them a notice needs, and the words of which a notice has one at least."""

    def __init__(self, license: str, text: str, least: float):
        self.license, self.words = license, [w for w, _, _ in words(text)]
        self.size, self.count = len(self.words), Counter(self.words)
        self.needed = max(1, ceil(least * self.size - 1e-9))
        self.signs = set(sorted(self.words, key=lambda w: (-len(w), w))[: self.size - self.needed + 1])
        self.reach = (2 * self.size - self.needed + 1, 2 * self.size)
        self.bits: dict[str, int] = {}
        for k, w in enumerate(self.words):
            self.bits[w] = self.bits.get(w, 0) | 1 << k

    def common(self, have: list[str], start: int) -> int:
        """Words of the longest common subsequence of the template and the widest window from `start` on. A bit is clear where the subsequence of the words so far grows."""
        whole = row = (1 << self.size) - 1
        for w in have[start : start + self.reach[1]]:
            here = row & self.bits.get(w, 0)
            if here:
                row = ((row + here) | (row - here)) & whole
        return self.size - row.bit_count()

    def align(self, have: list[str], start: int) -> tuple[int, int, int] | None:
        """Words aligned, first and last word (in `have`) of the better window from `start` on; None if it has too few."""
        best = None
        for reach in self.reach:
            pairs = align(have[start : start + reach], self.words)
            if len(pairs) >= self.needed:
                now = (len(pairs), start + pairs[0][0], start + pairs[-1][0])
                best = now if best is None else max(best, now, key=dense)
        return best

    def starts(self, have: list[str]) -> Iterator[int]:
        """Places of the template's words from which on a window holds as many of its words as a notice needs."""
        at = [k for k, w in enumerate(have) if w in self.count]
        seen, both, end = Counter(), 0, 0
        for k, p in enumerate(at):
            while end < len(at) and at[end] < p + self.reach[1]:
                w = have[at[end]]
                seen[w] += 1
                both += seen[w] <= self.count[w]
                end += 1
            if both >= self.needed:
                yield p
            w = have[p]
            both -= seen[w] <= self.count[w]
            seen[w] -= 1

    def notices(self, have: list[str]) -> Iterator[tuple[int, int, int]]:
        """Words aligned, first and last word of the notices, from left to right."""
        best, next_ = None, 0
        for p in self.starts(have):
            if best is not None and p > best[2]:
                yield best
                best = None
            if p < next_ or best is not None and best[0] == self.size == best[2] - best[1] + 1:
                continue
            next_ = p + self.needed - self.common(have, p)
            if next_ > p:
                continue
            now = self.align(have, p)
            if now is not None and (best is None or now[1] <= best[2] and dense(now) > dense(best)):
                best = now
        if best is not None:
            yield best


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...], least: float):
        import ahocorasick

        self.templates = [t for t in (Template(name, text, least) for name, text in templates) if t.size]
        self.auto, of = ahocorasick.Automaton(), {}
        for k, t in enumerate(self.templates):
            for w in t.signs:
                of.setdefault(w, set()).add(k)
        for w, ks in of.items():
            self.auto.add_word(w, ks)
        if of:
            self.auto.make_automaton()

    def __call__(self, text: str) -> list[dict]:
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        wanted: set[int] = set().union(*{id(ks): ks for _, ks in self.auto.iter(low)}.values()) if self.templates else set()
        if not wanted:
            return []
        own = words(low)
        have = [w for w, _, _ in own]
        found = []
        for k in sorted(wanted):
            t = self.templates[k]
            found += [{"license": t.license, "matched": n, "coverage": n / t.size, "start": own[a][1], "end": own[b][2]} for n, a, b in t.notices(have)]
        starts: list[int] = []
        ends: list[int] = []
        out = []
        for x in sorted(found, key=lambda x: (-x["matched"], -x["coverage"], x["start"], x["license"])):  # of notices that overlap, the one with more words
            k = bisect_left(starts, x["start"])
            if (k == 0 or ends[k - 1] <= x["start"]) and (k == len(starts) or x["end"] <= starts[k]):
                starts.insert(k, x["start"])
                ends.insert(k, x["end"])
                out.append(x)
        return sorted(({k: x[k] for k in ("license", "coverage", "start", "end")} for x in out), key=lambda x: (x["start"], x["license"]))


NOTICES = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """`docs` with _notices. templates: (licence, text); a list of bounded size that goes to each task."""
    docs = docs.drop("_notices")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            found = [scanner(t) if t else [] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _ARROW)], [*batch.schema.names, "_notices"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_notices", NOTICES)]))


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, license (of the notice with the highest coverage, the first of equals), coverage, n_notices and licenses (sorted) of each document."""
    out = scan(docs.select("doc_id", "text"))
    better = lambda x, y: F.when(x["coverage"] > y["coverage"], -1).when(x["coverage"] < y["coverage"], 1).otherwise(x["start"] - y["start"])
    best = F.get(F.array_sort("_notices", better), 0)
    return out.select("doc_id", best["license"].alias("license"), F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"), F.size("_notices").alias("n_notices"), F.array_sort(F.array_distinct(F.transform("_notices", lambda x: x["license"]))).alias("licenses"))
