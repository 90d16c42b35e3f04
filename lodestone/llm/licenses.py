"""License scans by patience alignment.

A text and a license template are aligned word by word: words that occur once in both are anchors, the
longest increasing subsequence of anchors is kept, and the gaps between them are aligned in the same way
(after equal words at both ends of a gap). Coverage is the share of the template's words that are
aligned. So that several or repeated notices in one long text do not hide each other, the alignment runs on windows:
one for each place where a seed word of the template (a word that ordinary prose lacks) occurs.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory

WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
MIN_COVERAGE = 0.8

#: Short notices and public license texts, by identifier.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
        and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
        WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
        OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice appear in
        all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO
        THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
        AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
        RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met: 1. Redistributions of source code must
        retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
        and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the
        terms of the GNU General Public License as published by the Free Software Foundation, either version 3
        of the License, or (at your option) any later version. This program is distributed in the hope that it
        will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
}
#: Words that ordinary prose has, so they start no window.
COMMON = frozenset(
    "a all and any are as at be but by copy do for form free from in is it kind law list loss met more must not of on or other out person provided see shall that the this to under use work will with without you".split()
)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]
    seeds: tuple[tuple[str, int], ...]  # word, its place in the template
    rare: tuple[str, ...]  # the seeds' words, the longest first


def templates(texts: dict[str, str]) -> tuple[Template, ...]:
    out = []
    for name, text in texts.items():
        words = words_of(text)
        once = {w for w, n in Counter(words).items() if n == 1}
        seeds = tuple((w, k) for k, w in enumerate(words) if w in once and w not in COMMON)
        seeds = seeds or tuple((w, k) for k, w in enumerate(words))
        out.append(Template(name, tuple(words), seeds, tuple(sorted({w for w, _ in seeds}, key=lambda w: (-len(w), w)))))
    return tuple(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by the first) that increases in the second."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        j = bisect.bisect_left(tails, b)
        back.append(ends[j - 1] if j else -1)
        tails[j : j + 1], ends[j : j + 1] = [b], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str] | tuple[str, ...], b: list[str] | tuple[str, ...]) -> list[tuple[int, int]]:
    """Patience alignment: pairs of places of equal words, increasing in both."""
    out, stack = [], [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(b[b0:b1], b0) if cb[w] == 1}
        anchors = _increasing([(k, place[w]) for k, w in enumerate(a[a0:a1], a0) if ca[w] == 1 and w in place])
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        stack += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:], strict=False) if p + 1 < q and r + 1 < s]
    return sorted(out)


def _possible(low: str, t: Template, min_coverage: float) -> bool:
    """False if so many seeds are missing from the text that the coverage cannot be reached."""
    spare = len(t.words) - math.ceil(min_coverage * len(t.words))
    present = 0
    for w in t.rare:
        if w in low:
            present += 1
        elif (spare := spare - 1) < 0:
            return False
    return present > 0


def _interrupted(words: list[str], t: Template, where: dict[str, list[int]], taken: list[tuple[int, int]], min_coverage: float) -> list[tuple[str, int, int, float]]:
    """The notices of a template in the stretches between the taken ones, each stretch aligned as a whole."""
    out, n = [], len(t.words)
    least, need = math.ceil(min_coverage * n), Counter(t.words)
    edges = [0, *[x for span in sorted(taken) for x in span], len(words)]
    stretches = list(zip(edges[::2], edges[1::2], strict=True))
    while stretches:
        lo, hi = stretches.pop()
        if hi - lo < least:
            continue
        missing = 0
        for w in t.rare:
            at = where.get(w, ())
            k = bisect.bisect_left(at, lo)
            missing += k == len(at) or at[k] >= hi
        if missing > n - least or missing == len(t.rare):
            continue
        have = Counter(w for w in words[lo:hi] if w in need)
        if sum(min(k, have[w]) for w, k in need.items()) < least:
            continue
        pairs = align(words[lo:hi], t.words)
        if len(pairs) / n >= min_coverage:
            a, b = lo + pairs[0][0], lo + pairs[-1][0] + 1
            out.append((t.name, a, b, len(pairs) / n))
            stretches += [(lo, a), (b, hi)]
    return out


def scan_text(text: str, known: tuple[Template, ...], min_coverage: float = MIN_COVERAGE) -> list[tuple[str, int, int, float]]:
    """(template, first word, word behind the last, coverage) of every notice in a text, in order.

    Of windows that overlap in a template, the one with the best coverage (then the first) counts. What lies between these is
    aligned as a whole where it has enough of the template's words, so a notice may be interrupted by any number of
    words; but of several such notices of one template in a row, whose words are then not unique, some may be missed.
    """
    low = text.lower()
    live = [t for t in known if _possible(low, t, min_coverage)]
    if not live:
        return []
    words = WORD.findall(low)
    where: dict[str, list[int]] = {}
    wanted = {w for t in live for w, _ in t.seeds}
    for k, w in enumerate(words):
        if w in wanted:
            where.setdefault(w, []).append(k)
    out = []
    for t in live:
        n, found = len(t.words), []
        slack = max(2, n // 4)
        starts = sorted({p - q for w, q in t.seeds for p in where.get(w, ())})
        clear = -1
        for k, s in enumerate(starts):
            # one window for a run of nearly equal starts
            if s <= clear:
                continue
            run_end = max(x for x in starts[k : bisect.bisect_right(starts, s + slack)])
            clear = run_end
            lo, hi = max(0, s - 1), min(len(words), run_end + n + slack)
            pairs = align(words[lo:hi], t.words)
            coverage = len(pairs) / n
            if coverage >= min_coverage:
                found.append((-coverage, lo + pairs[0][0], lo + pairs[-1][0] + 1))
        taken: list[tuple[int, int]] = []
        for c, lo, hi in sorted(found):
            if all(hi <= x or lo >= y for x, y in taken):
                taken.append((lo, hi))
                out.append((t.name, lo, hi, -c))
        out += _interrupted(words, t, where, taken, min_coverage)
    return sorted(out, key=lambda r: (r[1], r[2], r[0]))


def scan_licenses(docs: DataFrame, texts: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per notice found: doc_id, license, first_word, end_word, coverage.

    Word places count the runs of ``[a-z0-9]`` (with inner dots and hyphens) of the lower-cased text.

    Defined cases: a null or empty text has no notice; a null id is carried along; a notice that occurs twice gives two rows;
    repeated rows repeat; other columns are ignored. Whole texts are scanned, each in its own task.
    """
    known = templates(TEMPLATES if texts is None else texts)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], [[], [], [], []]
            for k, text in enumerate(batch.column(1).to_pylist()):
                for hit in scan_text(text, known, min_coverage) if text else ():
                    take.append(k)
                    for column, value in zip(rows, hit, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int64())), *[pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)]],
                names=["doc_id", "license", "first_word", "end_word", "coverage"],
            )
        release_memory()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, license string, first_word long, end_word long, coverage double")
