"""License scan: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

Templates are cut into runs of a few words; of every window of runs the one of least hash is kept (winnowing), in
an index from hash to (template, position). Runs and windows are as short as it takes for a hit in any text that has
the template with as many edits as its coverage allows, and one at least. A text's runs are looked up there. Hits on nearby diagonals are one
candidate, which is aligned with its template inside a band. Of finds that overlap, the one that fits best stays.

Templates of different licences can differ in a word or two (a version, ``ShareAlike``, ``Lesser``). Each template is
aligned with those like it, which gives its telling words: its own, that a find must have, and those of others, that
a find mustn't have in between. So a text of a licence that isn't listed isn't reported as its neighbour either.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, process_cache, windows, word_hashes

RUN, COVERAGE = 3, 0.8
#: Templates of two licences of which so many of the shorter one's words align are told apart by the other words.
ALIKE = 0.7

#: Longer templates aren't compared with each other for telling words; whole texts differ enough as they are.
MOST_COMPARED = 400

#: The wording of common notices and licences.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved."],
}

#: The parts that Creative Commons licences are named by, and identifiers that tags name.
CC_PARTS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
SPDX = "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL OFL-1.1 PostgreSQL Python-2.0 Unlicense WTFPL Zlib".split()
MIT_DISCLAIMER = "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."


def templates_of(texts: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, str]]:
    """(licence, text) of the notices, the Creative Commons family, tags, and the whole texts that come with the package."""
    out = [(name, t) for name, own in texts.items() for t in own] + [("MIT", MIT_DISCLAIMER)]
    known = {t for _, t in out}
    for part, words in CC_PARTS.items():
        for version in ("4.0", "3.0"):
            where = "International" if version == "4.0" else "Unported"
            out += [(f"CC-{part}-{version}", t) for t in (f"Licensed under CC {part} {version}.", f"This work is licensed under a Creative Commons {words} {version} {where} License.") if t not in known]
    out += [(name, f"SPDX-License-Identifier: {name}") for name in SPDX]
    return out + [(f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]

_WORD = re.compile(r"\S+")
_MARKS = b""".,;:!?"'`()[]{}<>"""


def _plain(text: str) -> tuple[list[bytes], list[int]]:
    """Lower-cased words without punctuation, and the position of each among the words of text."""
    words, at = [], []
    for i, w in enumerate(text.lower().split()):
        w = w.encode("utf-8", "replace").translate(None, _MARKS)
        if w:
            words.append(w)
            at.append(i)
    return words, at


def untouched(n: int) -> int:
    """How many words in a row of a template of n words any find has, where edits fall as badly as they can."""
    lost = int((1 - COVERAGE) * n + 1e-9)
    return -(-(n - lost) // (max(1, lost) + 1))  # a word put in between takes none away, but parts two runs


class Index:
    """An inverted index of the winnowed fingerprints of templates (name, text)."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.templates = []
        self.runs: set[int] = set()  # the lengths of runs
        found: dict[int, list[tuple[int, int]]] = {}
        for name, text in templates:
            words, _ = _plain(text)
            if len(words) < 2:
                continue
            t = len(self.templates)
            hashes = word_hashes(b" ".join(words))
            self.templates.append((name, hashes.tolist()))
            run = min(RUN, untouched(len(words)))
            window = untouched(len(words)) - run + 1
            runs = windows(hashes, run).tolist()
            self.runs.add(run)
            for i in range(max(1, len(runs) - window + 1)):
                x, at = min((x, j) for j, x in enumerate(runs[i : i + window], i))
                if (t, at) not in found.setdefault(x, []):
                    found[x].append((t, at))
        self.found = found
        self.bags = [Counter(words) for _, words in self.templates]
        self.own: list[set[int]] = [set() for _ in self.templates]  # positions of telling words
        self.others: list[set[int]] = [set() for _ in self.templates]  # telling words of templates like this one
        for a, (x, p) in enumerate(self.templates):
            for b, (y, q) in enumerate(self.templates[:a]):
                if x == y or min(len(p), len(q)) < ALIKE * max(len(p), len(q)) or max(len(p), len(q)) > MOST_COMPARED:
                    continue
                if (self.bags[a] & self.bags[b]).total() < ALIKE * min(len(p), len(q)):
                    continue
                pairs = align(p, q, 0, 0, max(2, len(p) // 4))
                if len(pairs) < ALIKE * min(len(p), len(q)):
                    continue
                i, j = {i for i, _ in pairs}, {j for _, j in pairs}
                self.own[a] |= set(range(len(p))) - i
                self.own[b] |= set(range(len(q))) - j
                self.others[a] |= {q[k] for k in range(len(q)) if k not in j} - set(p)
                self.others[b] |= {p[k] for k in range(len(p)) if k not in i} - set(q)
        self.marks = np.zeros(1 << 20, bool)
        if found:
            self.marks[(np.array(list(found), np.uint64) >> np.uint64(44)).astype(np.int64)] = True

    def candidates(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, least start, greatest start) of stretches of text that share fingerprints with a template."""
        starts: dict[int, list[int]] = {}
        for k in self.runs:
            if len(words) < k:
                continue
            runs = windows(words, k)
            for at in np.flatnonzero(self.marks[(runs >> np.uint64(44)).astype(np.int64)]).tolist():
                for t, offset in self.found.get(int(runs[at]), ()):
                    starts.setdefault(t, []).append(at - offset)
        out = []
        for t, own in starts.items():
            own.sort()
            slack = max(2, len(self.templates[t][1]) // 4)
            lo = hi = own[0]
            for s in own[1:]:
                if s - hi > slack:
                    out.append((t, lo, hi))
                    lo = s
                hi = s
            out.append((t, lo, hi))
        return out

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(licence, coverage, matched words, start, end) in code points; of overlapping finds that with most words matched over words missing or between."""
        if not text:
            return []
        data = " ".join(text.lower().split()).encode("utf-8", "replace").translate(None, _MARKS)
        quick = word_hashes(b" ".join(data.split()))
        found = self.candidates(quick)
        if not found:
            return []
        words, at = _plain(text)
        listed = quick.tolist()
        places = [m.span() for m in _WORD.finditer(text)]
        good = []
        for t, lo, hi in found:
            name, template = self.templates[t]
            slack = max(2, len(template) // 4)
            begin, end = max(0, lo - slack), min(len(listed), hi + len(template) + slack)
            least = COVERAGE * len(template)
            if end - begin < least or (self.bags[t] & Counter(listed[begin:end])).total() < least:
                continue  # no alignment can match enough words
            pairs = align(template, listed[begin:end], lo - begin, hi - begin, slack)
            if not pairs or len(pairs) < least or not self.own[t] <= {i for i, _ in pairs}:
                continue
            first, last = begin + pairs[0][1], begin + pairs[-1][1]
            matched = {begin + j for _, j in pairs}
            between = [listed[j] for j in range(first, last + 1) if j not in matched]
            if self.others[t].isdisjoint(between):
                fit = 2 * len(pairs) - len(template) - len(between)
                good.append((len(pairs), name, len(pairs) / len(template), places[at[first]][0], places[at[last]][1], fit))
        out = []
        for n, name, share, s, e, _ in sorted(good, key=lambda x: (-x[5], -x[0], x[3], x[1])):
            at = bisect_right(out, s, key=lambda o: o[3])  # out is in order and without overlaps
            if (at == 0 or out[at - 1][4] <= s) and (at == len(out) or e <= out[at][3]):
                out.insert(at, (name, share, n, s, e))
        return out


def align(a: list[int], b: list[int], lo: int, hi: int, slack: int) -> list[tuple[int, int]]:
    """The equal positions (i, j) of a best alignment of a to a run of b, on diagonals from lo - slack to hi + slack.

    An equal pair gains 2, any other step costs 1; b's ends are free.
    """
    low, width = lo - slack, hi - lo + 2 * slack + 1
    none = -(10**9)
    at = np.arange(width)
    words = np.asarray(b, np.uint64)
    row, back = np.zeros(width, np.int64), []
    for i, x in enumerate(a):
        j = i + low + at  # the word of b that a[i] may stand opposite to
        held = (j >= 0) & (j < len(b))
        equal = np.zeros(width, bool)
        equal[held] = words[j[held]] == np.uint64(x)
        diagonal = np.where(held, row + np.where(equal, 2, -1), none)
        down = np.where((j >= -1) & (j < len(b)), np.concatenate((row[1:], [none])) - 1, none)
        best = np.maximum(diagonal, down)
        run = np.maximum.accumulate(np.where(j >= 0, best + at, none)) - at  # along a: words of b passed over
        new = np.where(held, run, best)
        before = np.concatenate(([none], new[:-1])) - 1
        steps = np.where(new == diagonal, np.where(equal, 1, 2), np.where(new == before, 3, 4))
        row = np.where((j >= -1) & (j < len(b)), new, none)
        back.append(np.where(row <= none // 2, 0, steps).astype(np.int8))
    rows = [row.tolist()]
    d = max(range(width), key=lambda k: (rows[-1][k], -k))
    out, i = [], len(a) - 1
    while i >= 0:
        step = int(back[i][d])
        if step == 1:
            out.append((i, i + low + d))
        if step in (1, 2):
            i -= 1
        elif step == 3:
            d -= 1
        elif step == 4:
            i, d = i - 1, d + 1
        else:
            break
    return out[::-1]


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """A row for each licence text found: (id_col, license, coverage, matched_words, start, end).

    coverage is the share of the template's words that the alignment matches, 0.8 or more; start and end are code
    points. Of overlapping finds the one with the most matched words over words that are missing or in between
    stays, of equals the one with more words, then the first. Null, empty and clean texts give no row; repeated rows
    each give their own; ids are cast to long and may be null; other columns are not read; an empty table gives an
    empty result. templates take the place of the ones that come with the package; those of one word are ignored.
    """
    listed = templates_of() if templates is None else [(name, t) for name, texts in templates.items() for t in texts]
    schema = pa.schema([("id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batch: pa.RecordBatch) -> dict:
        index = process_cache(("licenses", tuple(listed)), lambda: Index(listed))
        ids = batch.column("id").to_pylist()
        found = [(ids[i], *m) for i, text in enumerate(batch.column("text")) for m in index.scan(text.as_py())]
        return {f.name: [x[k] for x in found] for k, f in enumerate(schema)}

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(arrow_map(run, schema), "id long, license string, coverage double, matched_words int, start long, end long")
    return out.withColumnRenamed("id", id_col)
