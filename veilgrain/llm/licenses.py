"""License notices in texts, by patience alignment with templates.

Words that occur once in the text and once in the template are anchors. Of these the longest
run that rises in both (patience sorting) is kept, and the gaps between its members are aligned
the same way, where more words are unique; equal words at the ends of a gap match, and in a gap
without a unique word its longest common subsequence does, as in a plain difference of texts.
Coverage is the share of the template's words that this alignment pairs; it decides.
Which stretches are aligned at all comes from a filter that loses none: bit vectors bound what
a stretch can have in common with the template, so copies side by side do not hide each other.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wording of license notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "MIT-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}
COVERAGE, STRETCH = 0.8, 2
WORD = re.compile(r"[^\s]+")
_EDGE = ".,;:!?()[]{}\"'*#%$&"


def normal(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) in lower case without the signs around it; words of signs alone are left out."""
    out = []
    for m in WORD.finditer(text):
        bare = m[0].strip(_EDGE).lower()
        if bare:
            out.append((bare, m.start(), m.end()))
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence that rises in the second place, of pairs that rise in the first."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        if pile == len(tops):
            tops.append(b)
            last.append(i)
        else:
            tops[pile], last[pile] = b, i
        back[i] = last[pile - 1] if pile else -1
    out = []
    i = last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _subsequence(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as positions; for gaps of at most a few template lengths."""
    rows = [[0] * (len(template) + 1)]
    for w in reversed(text):
        below, row = rows[-1], [0]
        for j in range(len(template) - 1, -1, -1):
            row.append(below[j + 1] + 1 if w == template[j] else max(below[j], row[-1]))
        rows.append(row[::-1])
    rows.reverse()
    out, i, j = [], 0, 0
    while i < len(text) and j < len(template) and rows[i][j]:
        if text[i] == template[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned positions (text, template), rising in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        once = Counter(text[a:b])
        place = {w: i for i, w in enumerate(text[a:b], a) if once[w] == 1}
        other = Counter(template[c:d])
        anchors = _rising(sorted((place[w], j) for j, w in enumerate(template[c:d], c) if other[w] == 1 and w in place))
        if not anchors:
            out += [(a + i, c + j) for i, j in _subsequence(text[a:b], template[c:d])]
            continue
        out += anchors
        ends = [(a - 1, c - 1), *anchors, (b, d)]
        work += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def _masks(template: list[str]) -> dict[str, int]:
    """The places of each word of a template as bits."""
    out: dict[str, int] = {}
    for j, w in enumerate(template):
        out[w] = out.get(w, 0) | 1 << j
    return out


def _common(words: Iterable[str], masks: dict[str, int], size: int) -> Iterator[int]:
    """Length of the longest common subsequence with the template after each word."""
    full = (1 << size) - 1
    row = full
    for w in words:
        hit = row & masks.get(w, 0)
        row = (row + hit | row - hit) & full
        yield size - row.bit_count()


def _places(marks: list[int], names: list[str], template: list[str], need: float) -> list[tuple[int, int, int]]:
    """(first word, last word, aligned words) of each notice, left to right; ``marks`` are the places of template words.

    A notice is a stretch of at most STRETCH template lengths that has ``need`` words or more in common with the
    template, in order. Of stretches that overlap the one that ends first is taken, so that as many as possible are found; each then
    grows over free words, no further than the next one's beginning, if that aligns more.
    """
    reach = STRETCH * len(template)
    size = len(template)
    ahead, back = _masks(template), _masks(template[::-1])
    words = [names[i] for i in marks]
    least: list[tuple[int, int]] = []
    begin = 0
    while begin < len(marks):
        # every short enough stretch that starts in the first half of these words ends in them
        stop = bisect_left(marks, marks[begin] + 2 * reach)
        end = next((k for k, n in enumerate(_common(words[begin:stop], ahead, size), begin) if n >= need), None)
        if end is None:
            begin = bisect_left(marks, marks[begin] + reach)
            continue
        start = next(end - k for k, n in enumerate(_common(reversed(words[begin : end + 1]), back, size)) if n >= need)
        # a stretch from an earlier start ends no sooner, so it is too long as well
        if marks[end] - marks[start] >= reach:
            begin = start + 1
            continue
        least.append((start, end))
        begin = end + 1
    out = []
    free = 0
    for k, (start, end) in enumerate(least):
        stop = least[k + 1][0] if k + 1 < len(least) else len(marks)
        stop = min(stop, bisect_left(marks, marks[start] + reach))
        sizes = list(_common(words[start:stop], ahead, size))
        end = start + sizes.index(sizes[-1])
        first = max(free, bisect_left(marks, marks[end] - reach + 1))
        sizes = list(_common(reversed(words[first : end + 1]), back, size))
        start = end - sizes.index(sizes[-1])
        out.append((marks[start], marks[end], sizes[-1]))
        free = end + 1
    return out


def find(text: str, templates: dict[str, list[str]], coverage: float = COVERAGE) -> list[dict]:
    """Notices in a text: template, coverage, start and end (code points), best first in each place."""
    plain = text.lower()
    templates = {name: t for name, t in templates.items() if sum(w in plain for w in t) >= coverage * len(t)}
    if not templates:
        return []
    words = normal(text)
    names = [w for w, _, _ in words]
    where: dict[str, list[int]] = {}
    for i, w in enumerate(names):
        where.setdefault(w, []).append(i)
    found = []
    for name, template in templates.items():
        need = coverage * len(template)
        known = set(template)
        if sum(w in where for w in template) < need:
            continue
        # candidate stretches: where words of the template stand close together
        marks = sorted(i for w in known for i in where.get(w, ()))
        reach = STRETCH * len(template)
        low = 0
        count: Counter = Counter()
        spans: list[list[int]] = []
        wanted = Counter(template)
        have = 0
        for high, i in enumerate(marks):
            count[names[i]] += 1
            have += count[names[i]] <= wanted[names[i]]
            while i - marks[low] >= reach:
                w = names[marks[low]]
                have -= count[w] <= wanted[w]
                count[w] -= 1
                low += 1
            if have >= need:
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = high + 1
                else:
                    spans.append([low, high + 1])
        for a, b in spans:
            for first, last, _ in _places(marks[a:b], names, template, need):
                own = marks[bisect_left(marks, first) : bisect_left(marks, last + 1)]
                pairs = align([names[i] for i in own], template)
                if len(pairs) >= need:
                    begin, end = own[pairs[0][0]], own[pairs[-1][0]]
                    found.append({"license": name, "coverage": len(pairs) / len(template), "start": words[begin][1], "end": words[end][2]})
    found.sort(key=lambda x: (x["start"], -x["end"], x["license"]))
    return found


SPAN = "struct<license:string,coverage:double,start:long,end:long>"


def _scan(templates: dict[str, str], coverage: float):
    prepared = {name: [w for w, _, _ in normal(text)] for name, text in templates.items()}
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [find(x, prepared, coverage) if x else [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "notices"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, notices) for each row; ``notices`` holds (license, coverage, start, end) by place, end exclusive, code points.

    Words are compared in lower case without the signs around them. Every place where a template is covered to
    ``coverage`` within STRETCH times its length is reported, as many as fit side by side, also where a longer template covers it. A null or empty text has no notices; ids may
    be null or repeated.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan(templates or TEMPLATES, coverage), f"doc_id long, notices array<{SPAN}>")
