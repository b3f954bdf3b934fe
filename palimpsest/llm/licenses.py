"""Licence scans by a generalised suffix automaton of licence tokens.

The templates' tokens (lower-case runs of letters and digits) go into one suffix
automaton.  A text is streamed through it, which gives at each token the length
of the longest match that ends there and its state; the state and its suffix
links give the longest match with every place of every template.  Matches of
MIN_MATCH tokens or more that the next token doesn't extend at that place,
whether or not it extends one elsewhere, are the template's parts; parts in the
same order in text and template, with gaps of at most MAX_GAP tokens in either,
are chained.  A chain that covers at least `coverage` of the template's tokens is
a finding, and so the findings of a template don't depend on the other templates.

Defined cases: null and empty texts have no findings; a null doc_id is reported
as null; repeated rows are reported once each; of overlapping findings of one
template the one that covers more stays, of equal ones the first; a template
within another one's span is reported too; texts are streamed whole; an empty
table gives an empty one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices

WORD = re.compile(r"[^\W_]+")
MIN_MATCH, MAX_GAP, COVERAGE = 3, 12, 0.8

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software."
_BSD_1 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_2 = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."

TEMPLATES: dict[str, str] = {
    "MIT": _MIT,
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": _BSD_1,
    "GPL": _GPL.format(""),
    "LGPL": _GPL.format("Lesser "),
    "AGPL": _GPL.format("Affero "),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib": _ZLIB,
    "Unlicense": _UNLICENSE,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "All-rights-reserved": "All rights reserved.",
}
#: Whole texts, beside the parts above that name a licence alone.
TEMPLATES |= {
    "MIT-text": f"{_MIT} THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause-text": f"{_BSD_1} {_BSD_2}",
    "BSD-3-Clause-text": f"{_BSD_1} {_BSD_3} {_BSD_2}",
    "ISC-text": f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}",
    "0BSD-text": f"{_ISC}. {_ISC_WARRANTY}",
    "Zlib-text": f"{_ZLIB} Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0-text": "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "Unlicense-text": f"{_UNLICENSE[:-1]}, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "WTFPL-text": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
}


class Automaton(NamedTuple):
    vocabulary: dict[str, int]
    names: list[str]
    sizes: list[int]
    next: list[dict[int, int]]
    link: list[int]
    length: list[int]
    #: By state: (template, end position) of its strings' occurrences.
    ends: list[list[tuple[int, int]]]
    #: By template: its tokens, and None after the last.
    tokens: list[list[int | None]]


def build(templates: Mapping[str, str]) -> Automaton:
    """The generalised suffix automaton: each template is added from the root."""
    vocabulary: dict[str, int] = {}
    nxt, link, length = [{}], [-1], [0]
    ends: list[list[tuple[int, int]]] = [[]]

    def state(n: int) -> int:
        nxt.append({})
        link.append(-1)
        length.append(n)
        ends.append([])
        return len(length) - 1

    def clone_of(p: int, c: int, q: int) -> int:
        k = state(length[p] + 1)
        nxt[k] = dict(nxt[q])
        link[k] = link[q]
        link[q] = k
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = k
            p = link[p]
        return k

    def extend(last: int, c: int) -> int:
        q = nxt[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else clone_of(last, c, q)
        new, p = state(length[last] + 1), last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else clone_of(p, c, q)
        return new

    names, sizes, all_tokens = [], [], []
    for name, text in templates.items():
        tokens = [vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall(text.lower())]
        if not tokens:
            continue
        last = 0
        for i, c in enumerate(tokens):
            last = extend(last, c)
            ends[last].append((len(names), i + 1))
        names.append(name)
        sizes.append(len(tokens))
        all_tokens.append([*tokens, None])
    # occurrences of a string are those of all the strings that end in it
    for s in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        if link[s] > 0:
            ends[link[s]].extend(ends[s])
    return Automaton(vocabulary, names, sizes, nxt, link, length, [sorted(set(e)) for e in ends], all_tokens)


def statistics(tokens: list[int | None], a: Automaton) -> Iterator[tuple[int, int]]:
    """(match length, state) at each token: the longest suffix of the tokens so far that occurs in a template."""
    nxt, link, length = a.next, a.link, a.length
    state = size = 0
    for c in tokens:
        if c is None:
            state = size = 0
        else:
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                size += 1
            else:
                size = 0
        yield size, state


def anchors(tokens: list[int | None], a: Automaton, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(end, length, state) of the matches that the next token doesn't extend."""
    nxt, link, length = a.next, a.link, a.length
    found = []
    state = size = 0
    for i, c in enumerate(tokens):
        if c is None:
            if size >= min_match:
                found.append((i, size, state))
            state = size = 0
            continue
        t = nxt[state].get(c)
        if t is None:
            if size >= min_match:
                found.append((i, size, state))
            while state and t is None:
                state = link[state]
                size = length[state]
                t = nxt[state].get(c)
            if t is None:
                size = 0
                continue
        state = t
        size += 1
    if size >= min_match:
        found.append((len(tokens), size, state))
    return found


def parts(tokens: list[int | None], a: Automaton, min_match: int = MIN_MATCH) -> dict[int, list[tuple[int, int, int, int]]]:
    """By template: (start, end, template start, template end) of the matches that can be extended neither in the text nor at that place of the template."""
    by: dict[int, list[tuple[int, int, int, int]]] = {}
    for i, (size, state) in enumerate(statistics(tokens, a), 1):
        if size < min_match:
            continue
        after = tokens[i] if i < len(tokens) else None
        seen: set[tuple[int, int]] = set()
        while size >= min_match:
            # places of a suffix link that its state lacks match in no more than the link's length
            for t, e in a.ends[state]:
                if (t, e) not in seen:
                    seen.add((t, e))
                    if after is None or a.tokens[t][e] != after:
                        by.setdefault(t, []).append((i - size, i, e - size, e))
            state = a.link[state]
            size = a.length[state]
    return by


def best_chains(runs: list[tuple[int, int, int, int]], size: int, max_gap: int = MAX_GAP) -> tuple[list[int], list[int]]:
    """For each of a template's parts, in order, the most tokens that a chain ending with it covers, and where that begins in the text."""
    best = [p[1] - p[0] for p in runs]
    start = [p[0] for p in runs]
    low = 0
    for i, (s, e, ts, te) in enumerate(runs):
        while runs[low][0] < s - size - max_gap:
            low += 1
        for j in range(low, i):
            _, pe, _, pte = runs[j]
            # anchors may overlap; what the earlier one covers counts once
            cut = max(0, pe - s, pte - ts)
            if cut < e - s and -max_gap <= s - pe + cut <= max_gap and -max_gap <= ts - pte + cut <= max_gap and pte < te and pe < e and best[j] + e - s - cut > best[i]:
                best[i], start[i] = best[j] + e - s - cut, start[j]
    return best, start


def without_overlaps(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(covered, start, end): those that cover most stay, of equal ones the first, each only if it overlaps none that stays."""
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for n, s, e in sorted(spans, key=lambda x: (-x[0], x[1], x[2])):
        at = bisect_right(starts, s)
        if (at == 0 or ends[at - 1] <= s) and (at == len(starts) or e <= starts[at]):
            starts.insert(at, s)
            ends.insert(at, e)
            out.append((n, s, e))
    return out


def chains(by: dict[int, list[tuple[int, int, int, int]]], a: Automaton, coverage: float = COVERAGE, max_gap: int = MAX_GAP) -> list[tuple[int, int, int, int]]:
    """(template, first token, token after the last, template tokens covered), those that cover enough, without overlaps within a template."""
    out = []
    for t, runs in by.items():
        runs.sort()
        best, start = best_chains(runs, a.sizes[t], max_gap)
        good = [(n, s, p[1]) for n, s, p in zip(best, start, runs) if n >= coverage * a.sizes[t]]
        out += [(t, s, e, min(n, a.sizes[t])) for n, s, e in without_overlaps(good)]
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def scan(text: str | None, a: Automaton, coverage: float = COVERAGE) -> list[tuple[str, int, int, int, float]]:
    """(licence, start, end, template tokens covered, share covered); positions count characters."""
    low = (text or "").lower()
    tokens = list(map(a.vocabulary.get, WORD.findall(low)))
    # most texts have no match at all
    spans = chains(parts(tokens, a), a, coverage) if anchors(tokens, a) else []
    if not spans:
        return []
    if len(low) != len(text):  # lower case may change a text's length
        at = [m.span() for m in re.finditer(WORD, text) for _ in WORD.findall(m[0].lower())]
    else:
        at = [m.span() for m in WORD.finditer(low)]
    return [(a.names[t], at[s][0], at[e - 1][1], n, round(n / a.sizes[t], 4)) for t, s, e, n in spans]


def find_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, start, end, covered, coverage), a row for each finding; nothing is shuffled."""
    templates = dict(templates)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = build(templates)
        for batch in slices(batches, "text"):
            rows = [(i, *hit) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in scan(text, a, coverage)]
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()))], names=["doc_id", "license", "start", "end", "covered", "coverage"])

    return mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null"), kernel, "doc_id bigint, license string, start int, end int, covered int, coverage double")
