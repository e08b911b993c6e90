"""License scans: MinHash windows retrieve templates, exact containment confirms them.

Words are runs of letters, digits and non-ASCII bytes in lower case, shingles are ``SIZE`` of
them. A text holds a template of t distinct shingles where a run of ``span(t)`` consecutive
shingles has at least 75 % of them, and at least 75 % of those that a rival lacks: a template of another license
with half of its shingles or more. So notices that differ in a version or a name are told apart. To find such runs, a grid of overlapping windows is laid over
each text for every template length: each run lies whole in some window, and a window is so
short that its similarity to the template is a third at least. Each of ``HASHES`` minima is a
band of its own, so such a window shares none of them with probability (2/3)^32, 2e-6.
A window that shares a band is looked at exactly.

Templates are a parameter, and few; they travel with the function. Null and empty texts have
no words and hold nothing. Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factloom.llm.arrow import flat, mixed, odd_numbers, steps
from factloom.llm.words import ALNUM, Words

SIZE = 5
HASHES = 32
PERCENT = 75

_SEEDS = odd_numbers(HASHES, 29)

# Published license notices and sentences, by identifier. A text of the 3-clause BSD license holds what the
# 2-clause one has, and is listed under both.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
                   'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
                   "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
            "Software is furnished to do so, subject to the following conditions"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met"),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
                     "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
                     "disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                     "derived from this software without specific prior written permission."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                         "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                         "option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                         "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                         "option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                          "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
                          "option) any later version."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                          "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                          "option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
                          "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                          "option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
                "available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which "
                "accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
             "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
             "commercial applications, and to alter it and redistribute it freely"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
                'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the '
                "Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)


def span(shingles: int) -> int:
    """Most consecutive shingles of a text that may hold a template of so many."""
    return shingles + shingles // 2


def needed(shingles: int) -> int:
    return -(-shingles * PERCENT // 100)


def _minima(shingles: np.ndarray, k: int) -> np.ndarray:
    return (mixed(shingles) * _SEEDS[k] >> np.uint64(32)).astype(np.uint32)


class Templates:
    """The shingles and minima of templates, by their number of distinct shingles."""

    def __init__(self, templates: Sequence[tuple[str, str]]):
        offsets, data = flat(pa.array([text for _, text in templates], pa.string()))
        words = Words(data, offsets, ALNUM)
        short = [name for (name, _), n in zip(templates, np.diff(words.by_text)) if n < SIZE]
        if short:
            raise ValueError(f"templates of fewer than {SIZE} words: {short}")
        every = words.windows(SIZE)
        self.names = [name for name, _ in templates]
        self.sets = [np.unique(every[a: b - SIZE + 1]) for a, b in zip(words.by_text, words.by_text[1:])]
        # by template: for each shingle the rivals that lack it, and how many of those that a rival lacks are needed
        self.rivals: list[tuple[list[list[int]], list[int]]] = []
        for name, held in zip(self.names, self.sets):
            lacks: list[list[int]] = [[] for _ in held]
            least: list[int] = []
            for other, theirs in zip(self.names, self.sets):
                shared = np.isin(held, theirs)
                if other != name and 2 * shared.sum() >= len(held) and not shared.all():
                    for x in np.flatnonzero(~shared).tolist():
                        lacks[x].append(len(least))
                    least.append(needed(int((~shared).sum())))
            self.rivals.append((lacks, least))
        self.by_size: dict[int, list[int]] = {}
        for i, held in enumerate(self.sets):
            self.by_size.setdefault(len(held), []).append(i)
        self.minima = [np.array([_minima(held, k).min() for k in range(HASHES)]) for held in self.sets]

    def candidates(self, shingles: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, first and last + 1 shingle) of the windows that share a band with it."""
        n = len(shingles)
        if not n:
            return
        grids = []
        for size, members in self.by_size.items():
            stride = max(1, size // 2)
            wide = -(-(span(size) + stride - 1) // stride)  # strides of a window
            grids.append((stride, wide, members, {i: np.zeros(-(-n // stride), bool) for i in members}))
        strides = sorted({g[0] for g in grids})
        spread = mixed(shingles)
        for k in range(HASHES):
            value = (spread * _SEEDS[k] >> np.uint64(32)).astype(np.uint32)
            blocks = {s: np.minimum.reduceat(value, np.arange(0, n, s)) if s > 1 else value for s in strides}
            for stride, wide, members, found in grids:
                least = blocks[stride].copy()
                for j in range(1, min(wide, len(least))):
                    np.minimum(least[:-j], blocks[stride][j:], out=least[:-j])
                for i in members:
                    found[i] |= least == self.minima[i][k]
        for stride, wide, members, found in grids:
            for i in members:
                for w in np.flatnonzero(found[i]).tolist():
                    yield i, w * stride, min(n, (w + wide) * stride)

    def scan(self, words: Words) -> list[tuple[int, int, int, int, float]]:
        """(text, template, first word, last word + 1, containment) of each text's best run for
        each template that it holds; the earliest of equals."""
        shingles = words.windows(SIZE)
        if not len(shingles):
            return []
        last = words.by_text[1:] - SIZE + 1  # shingles from here on reach beyond the text
        best: dict[tuple[int, int], tuple] = {}
        for i, start, end in self.candidates(shingles):
            held = self.sets[i]
            size = len(held)
            text = int(np.searchsorted(words.by_text, start, "right")) - 1
            while text < len(last) and words.by_text[text] < end:  # a window may lie over several texts
                a, b = max(start, int(words.by_text[text])), min(end, int(last[text]))
                if a < b:
                    at = np.minimum(np.searchsorted(held, shingles[a:b]), size - 1)
                    good = np.flatnonzero(held[at] == shingles[a:b])
                    run = _best_run(good, at[good], span(size), needed(size), *self.rivals[i])
                    if run:
                        key, new = (text, i), (-run[0], a + run[1], a + run[2] + SIZE)
                        if key not in best or new < best[key]:
                            best[key] = new
                text += 1
        return [(t, i, a - int(words.by_text[t]), b - int(words.by_text[t]), -n / len(self.sets[i])) for (t, i), (n, a, b) in sorted(best.items())]


def _best_run(places: np.ndarray, which: np.ndarray, most: int, needs: int, lacks: list[list[int]], least: list[int]) -> tuple[int, int, int] | None:
    """(distinct shingles, first, last) of the run of at most ``most`` places that has the most distinct ones, of
    the runs with ``needs`` of them and, of those that each rival ``lacks``, as many as ``least`` says; the earliest of equals."""
    best, seen, low, distinct, owned, short = None, {}, 0, 0, [0] * len(least), len(least)
    places, which = places.tolist(), which.tolist()
    for high, place in enumerate(places):
        x = which[high]
        seen[x] = seen.get(x, 0) + 1
        if seen[x] == 1:
            distinct += 1
            for r in lacks[x]:
                owned[r] += 1
                short -= owned[r] == least[r]
        while place - places[low] >= most:
            x = which[low]
            seen[x] -= 1
            if not seen[x]:
                distinct -= 1
                for r in lacks[x]:
                    short += owned[r] == least[r]
                    owned[r] -= 1
            low += 1
        if distinct >= needs and not short and (best is None or distinct > best[0]):
            best = (distinct, places[low], place)
    return best


_MATCH = T.StructType([T.StructField("license", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("start", T.LongType()),
                       T.StructField("end", T.LongType()), T.StructField("containment", T.DoubleType())])


def scanned(df: DataFrame, text: str, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``df`` without ``text`` but with ``n_words`` and ``matches``: an array of (license, template,
    start, end, containment), by template. Words are counted from 0, end is the one after the last.

    Null and empty texts have 0 words and no match, texts are scanned whole, repeated rows are each scanned. Other columns stay, but
    for ones named as the new ones. An empty table gives an empty one.
    """
    fields = [f for f in df.schema.fields if f.name not in (text, "n_words", "matches")]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("matches", T.ArrayType(_MATCH))])
    known = Templates(templates)
    match = pa.list_(pa.struct([("license", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text):
                offsets, data = flat(part.column(text))
                words = Words(data, offsets, ALNUM)
                rows: list = [[] for _ in range(part.num_rows)]
                for t, i, a, b, share in known.scan(words):
                    rows[t].append({"license": known.names[i], "template": i, "start": a, "end": b, "containment": share})
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(np.diff(words.by_text), pa.int64()), pa.array(rows, match)],
                                                 names=schema.names)

    return df.mapInArrow(run, schema)
