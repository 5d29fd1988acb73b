"""License notices in documents by patience alignment against templates.

Words that occur once in both a stretch of text and a template are anchors; the longest increasing subsequence
of their places is kept, equal words next to anchors are taken along, and each gap between anchors is aligned
the same way. A template is found where the aligned words cover enough of it within a short enough span.
Stretches to align are those where as many of the template's words stand close together as coverage needs.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoa.llm import codepoints as cp
from stoa.llm.memory import small_batches
from stoa.session import free_name

# Well-known license notices, by SPDX-like name.
TEMPLATES: dict[str, str] = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0",
    "MIT line": "Released under the MIT License",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3",
    "Apache-2.0": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT warranty": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "CC-BY-SA-4.0 line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
}


def _words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of runs of letters and digits, in lower case."""
    alpha, lower = cp.letters()
    inside = alpha[points] | cp.digits()[points]
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return a, b, cp.word_hashes(lower[points], a, b)


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect.bisect_left(tails, v)
        back.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two sequences, in order."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        once = [(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in place]
        kept = [once[k] for k in longest_increasing([j for _, j in once])]
        if not kept:
            continue
        pairs += kept
        for (i0, j0), (i1, j1) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)], strict=True):
            todo.append((i0 + 1, i1, j0 + 1, j1))
    return sorted(pairs)


def notices(texts: list[str], templates: dict[str, str], coverage: float, density: float) -> list[tuple[int, str, float, int, int]]:
    """``(text, template, coverage, start, end)`` of notices, offsets in characters, in order of place.

    Of the found stretches of one template none overlap; different templates may cover the same words.
    """
    points, starts = cp.joined(texts)
    a, b, hashes = _words(points)
    doc = np.searchsorted(starts, a, "right") - 1
    found = []
    own_words = {name: _words(cp.joined([t])[0])[2] for name, t in templates.items()}
    known = np.unique(np.concatenate([*own_words.values(), np.zeros(0, np.uint64)]))
    k = np.searchsorted(known, hashes)
    at = np.flatnonzero(known[np.minimum(k, len(known) - 1)] == hashes) if len(known) else np.zeros(0, np.int64)
    k = k[at]  # the words that any template has; which of them a template has is looked up by their number
    for name, own in own_words.items():
        if not len(own):
            continue
        need = int(np.ceil(coverage * len(own)))
        reach = int(len(own) / density)
        has = np.zeros(len(known), bool)
        has[np.searchsorted(known, own)] = True
        spot = at[has[k]]
        if len(spot) < need:
            continue
        last = spot[need - 1 :]  # a stretch of enough of the template's words, from spot to last
        near = (last - spot[: len(last)] < reach) & (doc[last] == doc[spot[: len(last)]])
        done, b_list = -1, own.tolist()
        for s in spot[: len(last)][near].tolist():
            if s <= done:
                continue
            stop = min(s + reach, int(np.searchsorted(doc, doc[s], "right")))
            pairs = patience(hashes[s:stop].tolist(), b_list)
            if len(pairs) < need:
                continue
            first, end = s + pairs[0][0], s + pairs[-1][0]
            if len(pairs) / (end - first + 1) < density:
                continue
            base = starts[doc[s]]
            found.append((int(doc[s]), name, len(pairs) / len(own), int(a[first] - base), int(b[end] - base)))
            done = end
    return sorted(found, key=lambda f: (f[0], f[3], f[1]))


def notice_column(text: Column, templates: dict[str, str] | None = None, coverage: float = 0.8, density: float = 0.7) -> Column:
    """An array of ``license, coverage, start, end`` for each text; empty for null or empty texts."""
    templates = TEMPLATES if templates is None else templates

    @F.pandas_udf("array<struct<license: string, coverage: double, start: int, end: int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(len(batch))]
            for at, some in cp.slices(batch.tolist()):
                for i, name, part, start, end in notices(some, templates, coverage, density):
                    out[at + i].append({"license": name, "coverage": part, "start": start, "end": end})
            yield pd.Series(out)

    return run(text)


def with_licenses(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with ``licenses``, named longer where ``docs`` has such a column. Each row is scanned on its own."""
    small_batches(docs.sparkSession)
    return docs.withColumn(free_name(docs, "licenses"), notice_column(F.col(text), **options))
