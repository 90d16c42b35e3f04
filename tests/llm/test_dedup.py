"""Exact dedup and the Jaccard join against brute force."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import jaccard_join
from lodestone.llm.common import Scratch
from lodestone.llm.components import connected_components
from lodestone.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, norm string, pos int, id int"


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t or "")
    out = []
    for k, (doc, text) in enumerate(rows):
        group = [(-len(t or ""), d is None, d or 0, j) for j, (d, t) in enumerate(rows) if norm(t) == norm(text)]
        best = min(group)
        out.append((doc, rows[best[3]][0], len(group), best[3] == k, hashlib.sha256(norm(text).encode()).hexdigest()))
    return out


def some_texts():
    rng = random.Random(5)
    base = ["".join(rng.choice("ab é") for _ in range(rng.choice([0, 1, 3, 7, 8, 9, 40, 300]))) for _ in range(30)]
    rows = [(k, rng.choice(base)) for k in range(120)]
    rows += [(500, None), (501, ""), (502, " \n"), (None, base[3]), (None, None), (3, rows[3][1]), (3, rows[3][1]), (7, rows[8][1] + " "), (900, "x" * 5000), (901, "x" * 4999 + "y"), (902, "x" * 5000 + "\t")]
    return rows


@pytest.mark.parametrize("route", [F.xxhash64, lambda b: F.octet_length(b).cast("long"), lambda b: F.lit(1).cast("long")])
def test_exact_dedup(spark, route):
    rows = some_texts()
    frame = spark.createDataFrame([(d, t, "n", 1, 2) for d, t in rows], SCHEMA)
    got = exact_dedup(frame, block_bytes=4, route=route).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_exact(rows), key=key)


def test_exact_dedup_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_jaccard(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            parent[find(a)] = find(b)
    out = []
    for k, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((doc, len(sets[k]), (min(ids) if ids else None) if sets[k] else doc))
    return out


def near_copies():
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(300)]
    passage = [rng.choice(vocab) for _ in range(30)]
    rows = []
    for _ in range(40):
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 7, 8, 12, 25, 60, 150, 400]))]
        if rng.random() < 0.6:
            words[len(words) // 2 : len(words) // 2] = passage
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(copy) // 50))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1])] = [rng.choice(vocab)] * rng.choice([0, 1])
            rows.append((len(rows), " ".join(copy)))
            words = copy if rng.random() < 0.5 else words  # chains: the ends of one need not be similar
    rows += [(None, rows[5][1]), (None, "only one"), (1000, None), (1001, ""), (1002, " \t"), (4, rows[4][1]), (1003, rows[9][1].upper()), (1004, "x" * 30_000), (1005, "a\u00a0b c d e f")]
    return rows


def star_of_copies():
    """Copies with 0 to 7 edits of one text: the more edited ones are similar to the least edited ones only, or to none."""
    rng = random.Random(6)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(90):
        copy = list(base)
        for at in rng.sample(range(150), rng.randint(0 if k > 60 else 1, 7)):
            copy[at] = f"e{rng.random()}"
        rows.append((k, " ".join(copy)))
    return rows


@pytest.mark.parametrize("make", [near_copies, star_of_copies])
def test_jaccard_components(spark, make):
    rows = make()
    frame = spark.createDataFrame([(d, t, "n", 1, 2) for d, t in rows], SCHEMA).repartition(3)
    got = jaccard_join.jaccard_components(frame).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_jaccard(rows), key=key)


def unlinked_copies():
    """Groups of texts that share much but not enough, beside the star of copies."""
    rng, rows = random.Random(8), star_of_copies()
    for g in range(6):
        passage = [f"p{g}-{k}" for k in range(70)]
        rows += [(1000 + 10 * g + k, " ".join([*passage, *(f"q{rng.random()}" for _ in range(14))])) for k in range(4)]
    return rows


def test_further_rounds_take_only_groups_with_more_pairs(spark, monkeypatch):
    """And only the sketches of these groups' sets are shuffled to them."""
    rounds, across, held, passed = [], jaccard_join._across, jaccard_join._held, []

    def watched(live, sets, limit):
        found = across(live, sets, limit)
        rounds.append((live.select("g", "band").distinct().collect(), {(r["a"], r["b"]) for r in found.filter("more").collect()}))
        return found

    def counted(some, wanted):
        passed.append((some.count(), (out := held(some, wanted)).count(), wanted.distinct().count()))
        return out

    monkeypatch.setattr(jaccard_join, "_across", watched)
    monkeypatch.setattr(jaccard_join, "_held", counted)
    monkeypatch.setattr(jaccard_join, "NEAREST", 1)
    rows = unlinked_copies()
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_jaccard(rows))
    assert len(rounds) > 1 and len(rounds[1][0]) < len(rounds[0][0])
    assert all(set(map(tuple, now[0])) <= before[1] for before, now in itertools.pairwise(rounds))
    assert all(wanted <= out <= wanted + some // 4 for some, out, wanted in passed[1:])


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert [tuple(r) for r in jaccard_join.jaccard_components(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 1)]


def sets_from(*items):
    import numpy as np

    out = jaccard_join.Sets(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    out.items, out.sizes = np.concatenate(items), np.array([len(x) for x in items])
    out.starts = np.concatenate(([0], np.cumsum(out.sizes)))
    return out


def test_sketches_bound_the_difference():
    """Neither whole sketches nor parts differ in more places than the sets have different elements."""
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 5, 11, 15, 16, 17, 21, 70, 500, 1500, 3000):
        for d in (0, 1, n // 8, n // 4):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate([a[min(d, n - 1) :], rng.integers(0, 2**63, d, dtype=np.uint64) * np.uint64(2)]))
            pair, apart = sets_from(a, b), len(set(a.tolist()) ^ set(b.tolist()))
            x, y = (np.frombuffer(v, np.uint64) for v in pair.bits(np.arange(2)))
            length = 64 * min(len(x), len(y))
            assert np.bitwise_count(jaccard_join.folded(x, length) ^ jaccard_join.folded(y, length)).sum() <= apart
            keys = {}
            for low, (take, filled, most, key, owner) in enumerate(jaccard_join.parts_of(pair, np.arange(2))):
                for k, of in enumerate(take):
                    keys[jaccard_join.band_of(pair.sizes[[of]])[0] - low, of] = set(key[owner == k].tolist()), filled[k], most[k]
            both = [(keys[band, 0], keys[band, 1]) for band, of in keys if of == 0 and (band, 1) in keys]
            if 7 * apart <= len(a) + len(b):
                assert both
                assert any(p[0] & q[0] for p, q in both)  # of two similar sets one part is the same
            for p, q in both:
                assert len(p[0] - q[0]) <= apart or p[1] <= p[2]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
