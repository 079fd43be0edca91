"""License scans by patience alignment.

A text's words are aligned with each template: words that are unique in both are anchors, their longest increasing
subsequence is kept, and the gaps between are aligned in the same way; equal words at a gap's ends match directly.
Coverage is the share of a template's words that are matched.  Alignment runs over spans (half as long again as the
template) that hold enough of the template's words; where words repeat so that nothing is unique, a longest common
subsequence takes its place.  Every license with `least` coverage is reported unless a better one overlaps it; of
equal coverage the longer template wins, then the name.

Edge cases: null and empty texts have no license; repeated rows are scanned alike; a null doc_id stays null; whole
texts are scanned, whatever their length; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiberlake.llm.common import slices, text_of

# Public license texts and notices.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT (notice)": "Released under the MIT License",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-4.0 (notice)": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0 (notice)": "Licensed under CC BY-SA 4.0",
    "All rights reserved": "All rights reserved",
}
_WORD = re.compile(r"[^\W_]+")


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting."""
    tops, places, before = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before[i] = places[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(v)
            places.append(i)
        else:
            tops[pile], places[pile] = v, i
    out, at = [], places[-1] if places else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of a and b, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
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
        left, right = Counter(a[i:j]), Counter(b[k:m])
        where = {w: x for x, w in enumerate(b[k:m], k) if right[w] == 1}
        both = [(x, where[w]) for x, w in enumerate(a[i:j], i) if left[w] == 1 and w in where]
        kept = [both[x] for x in increasing([y for _, y in both])]
        if not kept:
            continue
        out += kept
        ends = [(i - 1, k - 1), *kept, (j, m)]
        todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(ends, ends[1:])]
    return sorted(out)


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, for windows without unique words."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for k in range(len(b) - 1, -1, -1):
            best[i][k] = best[i + 1][k + 1] + 1 if a[i] == b[k] else max(best[i + 1][k], best[i][k + 1])
    out, i, k = [], 0, 0
    while i < len(a) and k < len(b):
        if a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        elif best[i + 1][k] >= best[i][k + 1]:
            i += 1
        else:
            k += 1
    return out


def candidates(words: list[str], template: Counter, size: int, span: int, need: int) -> list[int]:
    """Starts of spans with at least `need` of the template's words, each counted as often as the template has it."""
    hits = [i for i, w in enumerate(words) if w in template]
    out, held, total, end = [], Counter(), 0, 0
    for start in hits:
        while end < len(hits) and hits[end] < start + span:
            w = words[hits[end]]
            held[w] += 1
            total += held[w] <= template[w]
            end += 1
        if total >= need:
            out.append(start)
        w = words[start]
        total -= held[w] <= template[w]
        held[w] -= 1
    return out


def matches(words: list[str], template: list[str], least: float) -> list[tuple[float, int, int]]:
    """(coverage, first word, last word) of every place of a template, left to right."""
    size, counts = len(template), Counter(template)
    span, need = size + size // 2 + 2, next(n for n in range(size + 1) if n / size >= least)
    starts, out, at = candidates(words, counts, size, span, need), [], 0
    while at < len(starts):
        x = starts[at]
        group = [s for s in starts[at : at + span] if s < x + span]
        best = None
        for how in (align, common):
            for s in group if how is align else group[:1]:
                found = how(words[s : s + span], template)
                if len(found) >= need:
                    x, y = s + found[0][0], s + found[-1][0]
                    # of the most words, the tightest
                    if best is None or (len(found), x - y) > (best[0], best[1] - best[2]):
                        best = (len(found), x, y)
            if best:
                break
        if best:
            out.append((best[0] / size, best[1], best[2]))
        after = best[2] if best else starts[at]
        while at < len(starts) and starts[at] <= after:
            at += 1
    return out


def scan_text(text: str, templates: dict[str, list[str]], least: float) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, last word) of every license, the best first; none overlap."""
    words = _WORD.findall(text.lower())
    known, found = set(words), []
    for name, template in templates.items():
        # each word that the text lacks is one that cannot be matched
        if (len(template) - sum(w not in known for w in template)) / len(template) >= least:
            found += [((cover, len(template), name, -x), (name, round(cover, 6), x, y)) for cover, x, y in matches(words, template, least)]
    out: list[tuple[str, float, int, int]] = []
    for _, m in sorted(found, reverse=True):
        if all(m[3] < o[2] or m[2] > o[3] for o in out):
            out.append(m)
    return out


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """doc_id, license (the best; null if none), coverage, first_word, last_word, licenses (all, the best first)."""
    forms = {n: _WORD.findall(t.lower()) for n, t in templates.items()}

    names, kinds = ["license", "coverage", "first_word", "last_word"], [pa.string(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 22):
                every = [scan_text(t, forms, least) for t in part.column("text").to_pylist()]
                found = [m[0] if m else (None, 0.0, None, None) for m in every]
                columns = [pa.array(c, t) for c, t in zip(zip(*found), kinds)]
                columns.append(pa.array([[dict(zip(names, x)) for x in m] for m in every], pa.list_(pa.struct(list(zip(names, kinds))))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", *names, "licenses"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, coverage double, first_word long, last_word long, licenses array<struct<license:string,coverage:double,first_word:long,last_word:long>>")
