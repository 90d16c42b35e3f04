"""Periodic runs of words: a suffix automaton, end positions merged small to large, neighbours as seeds.

A run of period q is a stretch in which words q apart are equal and which cannot grow. In the automaton of a word sequence
a state of length L stands for the longest word sequence with its set of end positions. If i < j are neighbours in that set
and j - i <= L, the L words before i and before j are equal and overlap or touch: a square of the smallest period j - i that
starts at i - L + 1. The sets are merged along the suffix links, the smaller ones into the largest, so every pair that becomes
a neighbour is looked at in the deepest state that holds both, where L is as long as it can be: no run starts earlier.
For runs of three periods or more the pair (end - q, end) is among the seeds, so the last seed of (start, q) is the run's end.

Only stretches that can hold a run go into an automaton. A run of at least 24 words and 3 periods repeats
all its words within sequences of 16 that occur twice in the text; equal sequences get equal names by doubling (1, 2, 4, 8, 16 words),
exactly, and what no repeated sequence covers is left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, release_memory

MIN_WORDS, MIN_PERIODS = 24, 3
#: Words that are looked at together; a longer text is looked at alone.
SLICE_WORDS = 200_000
RUNS = "array<struct<start:long,length:long,period:long>>"


class SuffixAutomaton:
    """States of a sequence of numbers: longest length, suffix link, transitions, and the end of the prefix that made a state (-1: a split)."""

    def __init__(self, words: list[int]):
        self.length, self.link, self.end, self.next = [0], [-1], [-1], [{}]
        last = 0
        for k, w in enumerate(words):
            last = self._extend(last, w, k)

    def _add(self, length: int, link: int, end: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.end.append(end)
        self.next.append(moves)
        return len(self.length) - 1

    def _extend(self, last: int, word: int, k: int) -> int:
        length, link, moves = self.length, self.link, self.next
        new, p = self._add(length[last] + 1, 0, k, {}), last
        while p >= 0 and word not in moves[p]:
            moves[p][word] = new
            p = link[p]
        if p < 0:
            return new
        q = moves[p][word]
        if length[q] == length[p] + 1:
            link[new] = q
            return new
        split = self._add(length[p] + 1, link[q], -1, dict(moves[q]))
        while p >= 0 and moves[p].get(word) == q:
            moves[p][word] = split
            p = link[p]
        link[q] = link[new] = split
        return new


def merged(sets: list[list[int]], length: int, seeds: dict[tuple[int, int], int]) -> list[int]:
    """The union of sets of negated ends (ascending), the smaller ones put into the largest; new neighbours become seeds (start, period) -> end."""
    sets.sort(key=len)
    most = sets.pop()
    of = {x: k for k, small in enumerate(sets) for x in small}
    for x in of:
        insort(most, x)
    for x, k in of.items():
        at = bisect_left(most, x)
        for y in most[max(0, at - 1) : at] + most[at + 1 : at + 2]:
            if of.get(y, -1) != k and abs(x - y) <= length:
                i, j = -max(x, y), -min(x, y)
                key = (i - length + 1, j - i)
                if seeds.get(key, -1) < j:
                    seeds[key] = j
    return most


def find_runs(words: list[int], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``min_words`` words and ``min_periods`` (3 or more) periods, in order."""
    sam = SuffixAutomaton(words)
    sam.next.clear()
    seeds: dict[tuple[int, int], int] = {}
    below: list[list[list[int]] | None] = [None] * len(sam.length)
    for state in sorted(range(1, len(sam.length)), key=sam.length.__getitem__, reverse=True):
        sets = below[state] or []
        below[state] = None
        if sam.end[state] >= 0:
            sets.append([-sam.end[state]])
        ends = merged(sets, sam.length[state], seeds) if len(sets) > 1 else sets[0]
        up = sam.link[state]
        if up > 0:
            if below[up] is None:
                below[up] = []
            below[up].append(ends)
    found = [(s, e - s + 1, q) for (s, q), e in seeds.items()]
    return sorted((x for x in found if x[1] >= max(min_words, min_periods * x[2])), key=lambda x: (x[0], x[2]))


def repeated_stretches(ids: np.ndarray, doc: np.ndarray, width: int) -> list[tuple[int, int]]:
    """[lo, hi) of what sequences of ``width`` (a power of two) words cover that occur twice in their own text."""
    name, size = ids.astype(np.int64), 1
    while True:
        live = np.flatnonzero(name >= 0)
        key = doc[live].astype(np.int64) * (int(name.max(initial=0)) + 1) + name[live]
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        again = count[back] > 1
        name = np.full(len(ids), -1, np.int64)
        name[live[again]] = back[again]
        if size == width:
            break
        left, right = name[:-size], name[size:]
        pairs = np.flatnonzero((left >= 0) & (right >= 0) & (doc[:-size] == doc[size:])) if len(ids) > size else np.empty(0, np.int64)
        longer = np.full(len(ids), -1, np.int64)
        longer[pairs] = np.unique(left[pairs] * len(ids) + right[pairs], return_inverse=True)[1]
        name, size = longer, size * 2
    starts = np.flatnonzero(name >= 0)
    if not len(starts):
        return []
    cut = np.flatnonzero((np.diff(starts) > width) | (np.diff(doc[starts]) != 0)) + 1
    return [(int(x[0]), int(x[-1]) + width) for x in np.split(starts, cut)]


def _runs_of_texts(texts: list[list[bytes]], min_words: int, min_periods: int) -> list[list[tuple[int, int, int]]]:
    sizes = np.array([len(x) for x in texts])
    first, out = np.cumsum(sizes) - sizes, [[] for _ in texts]
    doc = np.repeat(np.arange(len(texts)), sizes)
    if not len(doc):
        return out
    ids = pa.array([w for x in texts for w in x], pa.large_binary()).dictionary_encode().indices.to_numpy()
    width = 16 if min_words >= 24 else 1
    for lo, hi in repeated_stretches(ids, doc, width):
        if hi - lo >= min_words:
            k = int(doc[lo])
            shift = lo - int(first[k])
            out[k] += [(s + shift, n, q) for s, n, q in find_runs(ids[lo:hi].tolist(), min_words, min_periods)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that a run holds after its first period."""
    gone = bytearray(len(words))
    for s, n, q in runs:
        gone[s + q : s + n] = b"\1" * (n - q)
    return [w for w, x in zip(words, gone, strict=True) if not x] if runs else words


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start then period), collapsed (the text without the repeats, one space between words).

    Words are maximal runs of characters other than ASCII white space. Defined cases: a null, empty or blank text has no words, no runs and an
    empty collapsed text; a null id is carried along; repeated rows repeat; other columns are ignored; an empty table gives an empty
    result. A text of any length is handled whole, by the task that reads it; the automaton's memory goes with its longest repeated stretch.
    """
    if min_periods < 3 or min_words < 1:
        raise ValueError("runs need at least three periods")
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held, lo = [], 0, 0
            raw = batch.column(1)
            for k in range(batch.num_rows):
                value = raw[k].as_py()
                texts.append((value or b"").split())  # of bytes: ASCII white space
                held += len(texts[-1])
                if held >= SLICE_WORDS or k == batch.num_rows - 1:
                    found = _runs_of_texts(texts, min_words, min_periods)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(lo, len(texts)),
                            pa.array([len(x) for x in texts], pa.int64()),
                            pa.array([[{"start": s, "length": n, "period": q} for s, n, q in x] for x in found], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
                            pa.array([b" ".join(collapsed(x, r)) for x, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string()),
                        ],
                        names=["doc_id", "n_words", "runs", "collapsed"],
                    )
                    texts, held, lo = [], 0, k + 1
        release_memory()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, n_words long, runs {RUNS}, collapsed string")


def words_of(text: Column) -> Column:
    """The words of a text, null as none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{ASCII_SPACE}]+"), "")


def planted_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with a tail of a tenth of the texts made periodic, as the hash of the id says; a null id leaves its text as it is."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g, words = F.floor(h / 10), words_of(F.col(text_col))

    def edited(x: Column) -> Column:
        n = F.size(x["w"]).cast("long")
        a = x["g"] % n
        p = 1 + F.floor((n - a) / (3 + x["g"] % 8))
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(x["w"], (a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.concat_ws(" ", F.slice(x["w"], F.lit(1), a.cast("int")), tail))

    made = F.get(F.transform(F.array(F.struct(words.alias("w"), g.alias("g"))), edited), F.lit(0))
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.when(h % 10 == 0, made), F.col(text_col)).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the one of greatest length / period (ties: smallest start, then period) and digests of runs and collapsed text."""
    wins = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda acc, x: F.when(wins(x, acc), x).otherwise(acc))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.withColumn("_best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
