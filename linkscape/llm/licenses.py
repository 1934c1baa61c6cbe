"""License scans: MinHash bands over overlapping text windows find templates, exact shingle containment verifies them.

A find is a stretch of at most ``SLACK`` times a template's number of shingles t that holds ``CONTAINMENT`` of its distinct shingles: the one that holds
most, of these the shortest, of these the first; then again in what lies before and behind it, so copies side by side are finds of their own.
All texts of a step are one stream of shingles.  It is covered by windows of m blocks of a power of two of shingles, one window a block, so that every such stretch lies
whole in one.  The window then has a Jaccard similarity of at least J = CONTAINMENT * t / (window + t - CONTAINMENT * t) with the template, whatever else is in it, and with bands of
``ROWS`` rows (1 - J**ROWS)**bands, the chance to miss it, is at most ``MISS``.  Windows that share a band with a template are verified.
Notices of fewer than 2 * SHINGLE - 1 words are looked up whole: CONTAINMENT of at most four shingles is all of them.
Everything happens in one pass over the texts, with the templates (a fixed list) in each task.
"""

from __future__ import annotations

import bisect
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscape.llm.common import table
from linkscape.llm.shingles import PUNCTUATION, mix, words

SHINGLE = 5
CONTAINMENT = 0.8
#: Longest stretch in parts of a template; rows of a band; most chance to miss a stretch.
SLACK, ROWS, MISS = 1.25, 2, 1e-5
STEP_BYTES = 1 << 20
#: Shingles hashed at a time, in reach of the processor's cache.
SPAN = 1 << 15
_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
)
_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Names and notices, the default list: sentences that name a license, notices of files, and whole texts. Fixed values.
TEMPLATES = {
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in "
    'all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR '
    "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-text": _TERMS + _DISCLAIMER,
    "BSD-3-Clause-text": _TERMS + _NAMES + _DISCLAIMER,
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
    'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS '
    "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
    "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
    "PURPOSE. See the GNU General Public License for more details.",
    "MIT-name": "MIT License",
    "AGPL-3.0": "GNU Affero General Public License, version 3",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "This work is licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "LGPL-2.1": "GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "GNU Lesser General Public License, version 3.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MIT-release": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
    "no-reproduction": "All rights reserved. No part of this work may be reproduced without permission.",
}


def _grams(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(out)]
    return mix(out)


class Template:
    def __init__(self, name: str, grams: np.ndarray):
        self.name, self.set = name, np.unique(grams)
        t = len(self.set)
        self.need = math.ceil(CONTAINMENT * t - 1e-9)
        self.longest = int(SLACK * len(grams))
        self.step = 1 << max(0, (self.longest // 6).bit_length() - 1)
        self.blocks = -(-(self.longest + self.step - 1) // self.step)
        least = self.need / (self.blocks * self.step + t - self.need)
        self.bands = math.ceil(math.log(MISS) / math.log(1 - least**ROWS))


def _windows(v: np.ndarray, asked: dict[int, list[int]]) -> dict[tuple[int, int], np.ndarray]:
    """For each block size and number of blocks asked for, the least value of each window, one window a block; steps rise by twos."""
    out, step = {}, 1
    while step <= max(asked):
        if step in asked:
            power, width = v, 1
            for m in sorted(asked[step]):
                while 2 * width <= m:
                    power, width = np.minimum(power[: max(len(power) - width, 0)], power[width:]), 2 * width
                out[step, m] = power if m == width else np.minimum(power[: max(len(power) - m + width, 0)], power[m - width :])
        v, step = np.minimum(v[: len(v) // 2 * 2 : 2], v[1::2]), 2 * step
    return out


class Templates:
    def __init__(self, notices: dict[str, str]):
        """Notices need at least one word."""
        self.short: dict[int, list[tuple[str, np.uint64]]] = {}
        self.long: list[Template] = []
        for name, text in sorted(notices.items()):
            h, _ = words([text.encode()], PUNCTUATION)
            if not len(h):
                raise ValueError(f"{name}: no words")
            if len(h) < 2 * SHINGLE - 1:
                self.short.setdefault(len(h), []).append((name, _grams(h, len(h))[0]))
            else:
                self.long.append(Template(name, _grams(h)))
        n = ROWS * max((t.bands for t in self.long), default=0)
        self.seeds = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
        self.lows = [[mix(t.set * seed).min() for seed in self.seeds] for t in self.long]
        #: the reach of the widest window, in whole blocks of the widest step
        widest = max((t.step for t in self.long), default=1)
        self.reach = (-(-max((t.step * t.blocks for t in self.long), default=0) // widest) + 1) * widest

    def candidates(self, g: np.ndarray) -> list[list[int]]:
        """For each template the first shingles of windows that share a band with it."""
        found: list[set[int]] = [set() for _ in self.long]
        for at in range(0, len(g), SPAN):
            part = g[at : at + SPAN + self.reach]
            rest = np.full(self.reach, np.iinfo(np.uint64).max, np.uint64) if at + len(part) == len(g) else np.empty(0, np.uint64)
            for band in range(len(self.seeds) // ROWS):
                alive = [k for k, t in enumerate(self.long) if band < t.bands]
                asked: dict[int, list[int]] = {}
                for k in alive:
                    asked.setdefault(self.long[k].step, []).append(self.long[k].blocks)
                asked = {step: sorted(set(ms)) for step, ms in asked.items()}
                rows = range(band * ROWS, (band + 1) * ROWS)
                least = [_windows(np.concatenate((mix(part * self.seeds[r]), rest)), asked) for r in rows]
                for k in alive:
                    t = self.long[k]
                    hits = np.flatnonzero(least[0][t.step, t.blocks] == self.lows[k][rows[0]])
                    for r, low in zip(rows[1:], least[1:], strict=True):
                        hits = hits[low[t.step, t.blocks][hits] == self.lows[k][r]]
                    found[k].update((at + hits * t.step).tolist())
        return [sorted(f) for f in found]

    def scan(self, h: np.ndarray, first: np.ndarray) -> list[list[tuple[str, int, int, float]]]:
        """``(name, first word, end word, containment)`` for each text, by name, then place; ``first`` is where texts begin in the word hashes, and the end."""
        found: list[list[tuple[str, int, int, float]]] = [[] for _ in first[1:]]
        for n, own in self.short.items():
            sequences = _grams(h, n)
            for name, low in own:
                at = np.flatnonzero(sequences == low)
                for text, place in zip((np.searchsorted(first, at, "right") - 1).tolist(), at.tolist(), strict=True):
                    if place + n <= first[text + 1]:
                        found[text].append((name, int(place - first[text]), int(place - first[text]) + n, 1.0))
        g = _grams(h)
        for t, starts in zip(self.long, self.candidates(g), strict=True):
            for a, z in _joined(starts, t.step * t.blocks):
                # a stretch of windows may cover the ends of texts: each text's own shingles apart
                text = int(np.searchsorted(first, a, "right") - 1)
                while text < len(found) and first[text] < z:
                    low, high = max(a, int(first[text])), min(z, int(first[text + 1]) - SHINGLE + 1)
                    if high - low >= t.need:
                        part = g[low:high]
                        places = np.flatnonzero(np.isin(part, t.set))
                        for p, q, n in _stretches((places + low - int(first[text])).tolist(), part[places].tolist(), t):
                            found[text].append((t.name, p, q, n / len(t.set)))
                    text += 1
        return [sorted(set(f)) for f in found]


def _joined(starts: list[int], width: int) -> list[tuple[int, int]]:
    """Windows that meet, as one."""
    out: list[tuple[int, int]] = []
    for a in starts:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], a + width)
        else:
            out.append((a, a + width))
    return out


def _stretches(places: list[int], grams: list[int], t: Template) -> list[tuple[int, int, int]]:
    """``(first word, end word, distinct shingles)`` of the finds among a template's shingles at ``places``."""

    def from_(i: int, end: int) -> tuple[int, int, int, int] | None:
        """What starts at the i-th place and ends before the ``end``-th: most shingles, then the shortest."""
        seen, last = {grams[i]}, i
        for j in range(i + 1, end):
            if places[j] - places[i] >= t.longest:
                break
            if grams[j] not in seen:
                seen.add(grams[j])
                last = j
        return (-len(seen), places[last] - places[i], i, last) if len(seen) >= t.need else None

    n = len(places)
    heap = [x for i in range(n - t.need + 1) if places[i + t.need - 1] - places[i] < t.longest and (x := from_(i, n))]
    heapq.heapify(heap)
    taken: list[tuple[int, int, int]] = []
    while heap:
        count, _, i, j = heapq.heappop(heap)
        first, end = places[i], places[j] + SHINGLE
        at = bisect.bisect_right(taken, first, key=lambda x: x[0])
        if at and taken[at - 1][1] > first:
            continue  # starts in what is taken
        if at < len(taken) and taken[at][0] < end:
            # ends in what is taken: what stands before it is asked again
            if x := from_(i, bisect.bisect_right(places, taken[at][0] - SHINGLE)):
                heapq.heappush(heap, x)
            continue
        taken.insert(at, (first, end, -count))
    return taken


def _scan(notices: dict[str, str]):
    def run(batches):
        templates = Templates(notices)
        kind = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())]))
        for batch in batches:
            out, part, size = [], [], 0
            texts = batch.column("text").cast(pa.binary())
            for k, x in enumerate(texts):
                part.append(x.as_py() or b"")
                size += len(part[-1])
                if size >= STEP_BYTES or k == len(texts) - 1:
                    h, first = words(part, PUNCTUATION)
                    out += [[dict(zip(("license", "first_word", "end_word", "containment"), f, strict=True)) for f in found] for found in templates.scan(h, first)]
                    part, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "found"])

    return run


def license_scan(docs: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, found`` for each row; ``found`` lists ``struct(license, first_word, end_word, containment)``, by name, then place.

    Finds of different notices may overlap, as one text holds another. Words are runs of ASCII letters, digits and bytes beyond ASCII, A-Z lowered.  Null, empty and short texts find nothing; repeated rows and null ids stay; further columns are ignored.
    """
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("found array<struct<license: string, first_word: long, end_word: long, containment: double>>").fields])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scan(notices or TEMPLATES), schema)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` against the default notices."""
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("found").cast("long").alias("n_found"), F.array_join(F.array_distinct("found.license"), ",").alias("licenses"), F.array_max("found.containment").alias("containment"))
