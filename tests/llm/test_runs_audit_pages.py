"""Periodic runs, the filter audit and main-text extraction against brute force."""

import hashlib
import html
import itertools
import math
import random
import re
import zlib

import pytest

from lodestone.llm import filter_audit, main_text, periodic_runs
from lodestone.llm.common import Scratch

SPACE = re.compile(r"[\x20\x09-\x0d]+")


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


# --- periodic runs


def brute_runs(w, min_words=24, min_periods=3):
    out = set()
    for q in range(1, len(w) // min_periods + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - s
            if n >= max(min_words, min_periods * q) and not any(w[s : s + n - d] == w[s + d : s + n] for d in range(1, q)):
                out.add((s, n, q))
            i += 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def some_sequences(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        a = rng.choice([1, 2, 3, 6, 50])
        w = [rng.randrange(a) for _ in range(rng.choice([0, 1, 5, 23, 24, 30, 60, 150]))]
        for _ in range(rng.randrange(4)):
            p, r, at = rng.randrange(1, 14), rng.randrange(2, 12), rng.randrange(len(w) + 1)
            w[at:at] = ([rng.randrange(a) for _ in range(p)] * r)[: rng.randrange(1, p * r + 1)]
        yield w


@pytest.mark.parametrize("least", [(24, 3), (2, 3), (24, 4), (9, 3)])
def test_runs_equal_brute_force(least):
    for w in some_sequences(3, 400):
        assert periodic_runs.find_runs(w, *least) == brute_runs(w, *least)
        words = [b"w%d" % x for x in w]
        got = periodic_runs._runs_of_texts([words, [], words], *least)
        assert [sorted(x, key=lambda r: (r[0], r[2])) for x in got] == [brute_runs(w, *least), [], brute_runs(w, *least)]


def test_fewer_than_three_periods_are_refused(spark):
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string"), min_periods=2)


def brute_op12(doc, text):
    w = words_of(text)
    n, h = len(w), zlib.crc32(str(doc).encode()) if doc is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op12_digests(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["la", "ré", "mi", "x", " ", "日本"]) for _ in range(rng.choice([0, 3, 40, 200])))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (None, "a b " * 40), (None, None), (3, "to be " * 30), (3, "to be " * 30), (204, "a b " * 30), (205, "x" * 50_000 + " y" * 40), (206, "q " * 2000)]
    frame = spark.createDataFrame([(d, t, 1, "n") for d, t in rows], "doc_id long, text string, runs int, words string").repartition(3)
    got = periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.planted_repeats(frame))).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((brute_op12(*r) for r in rows), key=key)
    assert any(r[1] for r in got) and periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.planted_repeats(frame.limit(0)))).count() == 0


# --- filter audit


def brute_audit(docs, labels):
    marks, least = {}, {}
    for d, q, t in labels:
        if d is not None:
            good, bad = marks.get(d, (0, 0))
            marks[d] = (max(good, int(q == 1)), max(bad, int(t == 1)))
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(least.get(text or "", d), d)
    rows = []
    for d, text, part in docs:
        t, w = text or "", words_of(text)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and d > least[t],
        }
        rows.append((part or "", {k for k, v in fails.items() if v}, *(marks.get(d, (0, 0)) if d is not None else (0, 0))))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [r for r in own if f in r[1] and not r[1] & before]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    sum(not r[1] & (before | {f}) for r in own), len(gone), sum(f in r[1] and bool(r[1] & before) for r in own), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
        for (p, order, k), x in out.items():
            if p == part:
                x.append(shapley[order[k - 1]])
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(filter_audit, "FIRST_BLOCK", 8)
    monkeypatch.setattr(filter_audit, "GROWTH", 2)


@pytest.mark.parametrize("heavy", [1 / 1000, 1.0])
def test_audit_equals_brute_force(spark, small_blocks, monkeypatch, heavy):
    monkeypatch.setattr(filter_audit, "HEAVY", heavy)
    rng = random.Random(4)
    texts = ["", "Ab c", "a" * 8, "a" * 7 + "b", "same start here, x", "same start here, y", "w " * 250, " ".join(f"v{k}" for k in range(220)), "é" * 300 + "#", "É" * 40, "x" * 20_000, "x" * 19_999 + "y"]
    docs = [(k, rng.choice(texts), rng.choice(["s0", "s0", "s1", "", None])) for k in range(60)] + [(None, "Ab c", "s0"), (None, "Ab c", "s0"), (5, "Ab c", "s1"), (5, "Ab c", "s1"), (6, None, None), (91, None, "only")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 95, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, source string, mask int, part string").repartition(5)
    marks = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = filter_audit.filter_interactions(frame, marks).collect()
    want = brute_audit(docs, labels)
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in got} == want and len(got) == len(want)


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_interactions(docs, labels).count() == 0
    one = filter_audit.filter_interactions(spark.createDataFrame([(1, "A", None)], docs.schema), labels).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""} and sum(r["removed"] for r in one) == 120


def test_refinement_keeps_only_equal_looking_texts(spark, small_blocks):
    rows = [(1, 5, [1], 7), (2, 5, [1], 7), (3, 5, [2], 8), (4, 9, [1, 3], 1), (5, 9, [1, 4], 2), (6, 0, [], 3), (7, 0, [], 3)]
    slim = spark.createDataFrame(rows, "doc_id long, len int, blocks array<long>, final long")
    assert {r[0] for r in filter_audit.refine(slim, Scratch(spark, "t")).collect()} == {1, 2, 6, 7}


# --- main text

P = "Rain fell over the valley for three days, and the river rose. Farmers moved their animals uphill; nobody was hurt."
LINKS = "".join(f"<li><a href=/{k}>Link {k}</a></li>" for k in range(6))
PAGES = {
    "": "",
    "<nav><ul>" + LINKS + "</ul></nav>": "",
    "just text &amp; more  text\n\nhere": "just text & more text here",
    f"<article><h1>Title</h1><p>{P}<p>two &eacute;&#8212;&#x41; <b>bold<p>three <i>it</i>alic</article><footer>{P}</footer>": f"Title {P} two é—A bold three italic",
    f"<body><div id=top><a href=/>Home</a> <a href=/n>News</a></div><div><ul>{LINKS}</ul></div><div class=c><h1>Flood</h1><p>{P}</p><p>Short one.</p><h2>After</h2><p>{P}</p><ul><li>first point<li>second point</ul></div><div class=bottom-footer>by us</div>": f"Flood {P} Short one. After {P} first point second point",
    f"<header class=site><h1>My Site</h1></header><div class='cookie-notice'><p>{P}</p></div><main><article><header><h1>T</h1><p>by Me</p></header><p>{P}</p><div class=advert><p>Buy! {P}</p></div><section id=comments><h3>2 comments</h3><p>{P}</p></section></article></main><aside><p>{P}</p></aside>": f"T {P}",
    f"<body><div><p>{P}</p><p>{P}</p></div><div><h3>Comments</h3><p>{P}</p></div></body>": f"{P} {P}",
    f"<body><form action=x><div><p>{P}</p><input type=text><p>{P}</p></div></form></body>": f"{P} {P}",
    f"<table><tr><td><a href=1>Home</a><br><a href=2>Links</a></td><td><p>{P}<p>{P}<p>End.</td></tr></table>": f"{P} {P} End.",
    "<p>a<script>var x='</p><p>evil';</script>b</p><style>p{}</style><noscript>enable</noscript><!-- no --><p>c</p>": "a b c",
    f"<main><section><p>{P}</p></section><section><p>{P}</p></section></main><section class=related><article><p>{P}</p></article></section>": f"{P} {P}",
    "<article><p>1 < 2 and 3 > 2 & ok</p><p hidden>no</p><p style='display: none'>no</p></article>": "1 < 2 and 3 > 2 & ok",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert main_text.main_text(page) == PAGES[page]


def test_smoothing_sums_to_one():
    assert main_text.smoothed([2.0] * 5, 2) == pytest.approx([2.0] * 5) and main_text.smoothed([], 2) == []
    assert math.isclose(main_text.smoothed([0, 0, 1, 0, 0], 2)[2], max(main_text.smoothed([0, 0, 1, 0, 0], 2)))


def test_extraction_of_rows(spark):
    long = "<article>" + f"<p>{P}</p>" * 3000 + "</article>"
    rows = [(1, "u", "<p>a&nbsp;b", 5), (1, "u", "<p>a&nbsp;b", 5), (None, None, None, None), (2, "v", long, 1), (3, "w", "<div>" * 20_000 + "deep.", 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in main_text.extract_main_text(frame).collect() if r["page_id"] != 0)
    texts = ["", "a b", "a b", " ".join([P] * 3000), "deep."]
    assert [x[2] for x in got] == texts and [x[3] for x in got] == list(map(len, texts))
    assert main_text.extract_main_text(frame.limit(0)).count() == 0


def test_pages_of_the_table(spark):
    """The articles of the generated pages, whose markup is plain, by string functions."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in main_text.extract_main_text(pages).collect()}
    for r in pages.collect():
        article = re.sub(r"</?b>", "", r["html"].split("<article>")[1].split("</article>")[0])
        assert got[r["page_id"]] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
