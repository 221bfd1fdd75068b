"""License scans by patience alignment.

Words unique to both a stretch of text and a template are anchors; their longest increasing subsequence is kept, and the
gaps between are aligned in the same way, common beginnings and ends first. Coverage is the share of the template's words
that are aligned. Stretches lie around every place of the template words that are rarest in the text, so that long texts
and repeated notices are covered, and reach over the template's length and a fifth more on both sides (REACH). A template whose words are too few in a text for the coverage asked for is left out
beforehand, which is exact.

Defined cases: null and empty texts have no license; of overlapping hits of one template the better, then the earlier
counts; repeated rows give repeated results; other columns are ignored or carried.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of a template's words.
PERCENT = 80
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")

TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software "
    'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT": "Released under the MIT License",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
    "You can obtain one at https://mozilla.org/MPL/2.0/.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
    "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
    "notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
    "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "BSD-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
    "specific prior written permission.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in "
    "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
    "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE.",
}
#: Words that a covered stretch may hold besides the template's, at most, as a share of the template's (in percent).
REACH = 20


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by their first, in which the second rises."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        at = bisect.bisect_left(tails, y)
        back[k] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(y)
            ends.append(k)
        else:
            tails[at], ends[at] = y, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned (text index, template index), both rising."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        left, right = Counter(text[a:b]), Counter(template[c:d])
        unique = {w for w, n in right.items() if n == 1 and left.get(w) == 1}
        if not unique:
            continue
        where = {w: k for k, w in enumerate(template[c:d], c) if w in unique}
        anchors = _rising([(k, where[w]) for k, w in enumerate(text[a:b], a) if w in unique])
        for x, y in anchors:
            out.append((x, y))
            todo.append((a, x, c, y))
            a, c = x + 1, y + 1
        todo.append((a, b, c, d))
    return sorted(out)


_TEMPLATE_WORDS = {k: words(v) for k, v in TEMPLATES.items()}
_TEMPLATE_SETS = {k: set(v) for k, v in _TEMPLATE_WORDS.items()}


def find_licenses(text: str | None, percent: int = PERCENT) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, end word) for each stretch of the whole text that covers a template."""
    found = words(text)
    own = set(found)
    out = []
    for name, template in _TEMPLATE_WORDS.items():
        n, distinct = len(template), _TEMPLATE_SETS[name]
        allowed = n * (100 - percent) // 100  # words that may be missing
        if len(distinct & own) < len(distinct) - allowed:
            continue
        places: dict[str, list[int]] = {w: [] for w in distinct}
        for k, w in enumerate(found):
            if w in distinct:
                places[w].append(k)
        # more words than coverage allows to miss, the rarest in the text: a covered stretch holds one of them
        rare, missing = sorted(distinct, key=lambda w: (len(places[w]), w)), 0
        starts: list[int] = []
        for w in rare:
            missing += template.count(w)
            starts += places[w]
            if missing > allowed:
                break
        hits, reach = [], n + n * REACH // 100
        for k in sorted(set(starts)):
            a, b = max(0, k - reach), min(len(found), k + reach + 1)
            pairs = align(found[a:b], template)
            if len(pairs) >= n - allowed:
                hits.append((-len(pairs) / n, a + pairs[0][0], a + pairs[-1][0] + 1))
        taken: list[tuple[int, int]] = []
        for share, a, b in sorted(hits):
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                out.append((name, -share, a, b))
    return sorted(out, key=lambda x: (x[2], x[0]))


_HIT = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])


def _scan(texts: pa.Array) -> pa.Array:
    return pa.array([[dict(zip(("license", "coverage", "start", "end"), x, strict=True)) for x in find_licenses(t.as_py())] for t in texts], pa.list_(_HIT))


def scan(docs: DataFrame, text: str = "text", out: str = "licenses") -> DataFrame:
    """docs with the licenses found in each whole text, spans in words. One narrow pass."""
    return docs.withColumn(out, F.arrow_udf(_scan, "array<struct<license:string,coverage:double,start:int,end:int>>")(F.col(text)))


def license_query(docs: DataFrame) -> DataFrame:
    best = F.array_max(F.transform("licenses", lambda x: F.struct(x["coverage"], F.length(x["license"]).alias("n"), x["license"])))
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), best["license"].alias("license"), F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"), "licenses"
    )
