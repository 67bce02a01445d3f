"""License scan: normalised passages compared with licence templates by the Dice coefficient of their word bigrams.

Passages are the whole text, its paragraphs, lines and sentences, and beside what these match, runs of consecutive lines and
sentences that lie within a template's size bounds; only templates of which a text holds enough bigrams are looked for in runs. A coefficient of `least` is out of reach for templates
whose number of bigrams is too far from the passage's, so only templates within these bounds are looked at; of them, those
that share too few bigrams fall out of an inverted list before any set is intersected.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import slices

# --- fixed values: wordings of public licences and of their notices ----------------
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
            "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
            "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
            "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
            "IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
                   "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                   "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                     "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
                     "the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
                     "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
                  "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
                  "non-commercial, and by any means."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
]

#: The disclaimer that follows the conditions of the BSD licences.
DISCLAIMER = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
              "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
              "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
              "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
              "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
              "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
TEMPLATES += [(name, f"{t} {DISCLAIMER}") for name, t in TEMPLATES if name == "BSD-2-Clause" and t.startswith("Redistribution")]
#: Full texts, one file a licence.
TEMPLATES += [(f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]

WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^\W\d_])")
COPYRIGHT = re.compile(r"^\W*copyright\b.{0,200}$|^\W*\(c\)\s*[0-9]{4}.{0,200}$|^\W*all rights reserved\W*$", re.I)


def words(passage: str) -> list[str]:
    """Lower-cased words without punctuation; numbers keep their points."""
    return WORD.findall(passage.lower())


def bigrams(w: list[str]) -> frozenset[tuple[str, str]]:
    return frozenset(zip(w, w[1:]))


class Templates:
    """Bigram sets sorted by size, with an inverted list."""

    def __init__(self, templates: list[tuple[str, str]], least: float):
        self.least = least
        self.sets = sorted(((bigrams(words(t)), name) for name, t in templates), key=lambda x: len(x[0]))
        self.sizes = [len(s) for s, _ in self.sets]
        self.lists: dict[tuple[str, str], list[int]] = {}
        for i, (s, _) in enumerate(self.sets):
            for g in s:
                self.lists.setdefault(g, []).append(i)

    def bounds(self, size: int) -> tuple[int, int]:
        """The templates (from, to) that a passage of so many bigrams can match: 2 min / sum >= least."""
        reach = (2 - self.least) / self.least
        return bisect_left(self.sizes, size / reach), bisect_right(self.sizes, size * reach)

    def best(self, found: frozenset[tuple[str, str]]) -> tuple[float, str] | None:
        low, high = self.bounds(len(found))
        if low == high or not found:
            return None
        shared = Counter(i for g in found & self.lists.keys() for i in self.lists[g] if low <= i < high)
        scored = [(2 * n / (len(found) + self.sizes[i]), self.sets[i][1]) for i, n in shared.items()]
        top = max(scored, key=lambda x: (x[0], x[1]), default=None)
        return top if top and top[0] >= self.least else None


def pieces(text: str) -> list[tuple[int, list[str]]]:
    """(line, words) of the sentences of each line, in order, without lines of copyright."""
    return [(i, w) for i, line in enumerate(text.split("\n")) if not COPYRIGHT.match(line) for part in SENTENCE.split(line) if (w := words(part))]


def runs(text: str, table: Templates, matched: list[tuple[int, str]]) -> Iterator[tuple[int, float, str]]:
    """(line, coefficient, name) of runs of pieces that match a template, no two of which overlap each other or `matched`.

    Of runs that overlap, the one that shares most bigrams stays.
    """
    parts = pieces(text)
    all_words = [x for _, w in parts for x in w]
    grams = list(zip(all_words, all_words[1:]))
    need = table.least / (2 - table.least)
    held = Counter(i for g in set(grams) & table.lists.keys() for i in table.lists[g])
    wanted = [i for i, n in held.items() if n >= need * table.sizes[i]]
    if not wanted:
        return
    start = [0]
    for _, w in parts:
        start.append(start[-1] + len(w))
    taken = [False] * len(all_words)
    for line, passage in matched:
        w = words(passage)
        at = next((start[k] for k, (i, _) in enumerate(parts) if i >= line), len(all_words))
        at = next((o for o in range(at, len(all_words) - len(w) + 1) if all_words[o:o + len(w)] == w), None)
        if at is not None:
            taken[at:at + len(w)] = [True] * len(w)
    found: list[tuple[int, float, str, int, int]] = []
    for t in wanted:
        own, name = table.sets[t]
        hit = [any(g in own for g in grams[a:b - 1]) for a, b in zip(start, start[1:])]
        for first in range(len(parts)):
            if not hit[first] and len(parts[first][1]) > 1:
                continue
            seen: set[tuple[str, str]] = set()
            shared, best = 0, None
            for last in range(first, len(parts)):
                if any(taken[start[last]:start[last + 1]]):
                    break
                for g in grams[max(start[first], start[last] - 1):start[last + 1] - 1]:
                    if g not in seen:
                        seen.add(g)
                        shared += g in own
                if len(seen) * need > len(own):
                    break
                dice = 2 * shared / (len(seen) + len(own))
                if dice >= table.least and (best is None or (dice, -last) > (best[1], -best[4])):
                    best = shared, dice, name, first, last
            if best:
                found.append(best)
    for _, dice, name, first, last in sorted(found, key=lambda x: (-x[0], -x[1], x[3], x[4], x[2])):
        if not any(taken[start[first]:start[last + 1]]):
            taken[start[first]:start[last + 1]] = [True] * (start[last + 1] - start[first])
            yield parts[first][0], dice, name


def passages(text: str) -> Iterator[tuple[int, str]]:
    """(number of the first line, passage): the whole text, then paragraphs, lines and sentences that differ from those around them."""
    lines = [line for line in text.split("\n")]
    yield 0, "\n".join(line for line in lines if not COPYRIGHT.match(line))
    start = 0
    for i in range(len(lines) + 1):
        if i == len(lines) or not lines[i].strip():
            if 0 < i - start < len(lines) and i - start > 1:
                yield start, "\n".join(line for line in lines[start:i] if not COPYRIGHT.match(line))
            start = i + 1
    for i, line in enumerate(lines):
        if len(lines) > 1:
            yield i, line
        parts = SENTENCE.split(line)
        if len(parts) > 1:
            for part in parts:
                yield i, part


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = 0.9, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_passages, licenses, max_dice, matches) of every row's whole text.

    `licenses` are the names found, sorted and comma-joined; `matches` lists name:line:coefficient (lines from 0, in thousandths) in
    order of lines, each name once a line. n_passages is the number of matches. A null or empty text has none ('' and 0).
    Null keys and repeated rows stay rows of their own; ties go to the name that sorts last; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    table = Templates(templates or TEMPLATES, least)

    def look(value: str) -> tuple[int, str, float, str]:
        best: dict[tuple[int, str], float] = {}
        matched: list[tuple[int, str]] = []
        for line, passage in passages(value):
            if (hit := table.best(bigrams(words(passage)))) is None:
                continue
            best[line, hit[1]] = max(best.get((line, hit[1]), 0.0), hit[0])
            matched.append((line, passage))
        for line, dice, name in runs(value, table, matched):
            best[line, name] = max(best.get((line, name), 0.0), dice)
        matches = ",".join(f"{name}:{line}:{round(d * 1000)}" for (line, name), d in sorted(best.items()))
        return len(best), ",".join(sorted({n for _, n in best})), max(best.values(), default=0.0), matches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [look(t or "") for t in part.column(1).to_pylist()]
            types = (pa.int64(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(zip(*found), types)]],
                                             ["key", "n_passages", "licenses", "max_dice", "matches"])

    found = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"key {kind}, n_passages long, licenses string, max_dice double, matches string")
    return found.withColumnRenamed("key", key)
