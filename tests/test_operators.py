import random
import sqlite3

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import grep, ingest, search, store, usage
from lodestone.sources import tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(("tokenizer", "query"), [("porter unicode61", "running dogs"), ("porter unicode61", "dog"), ("trigram", "the dog"), ("trigram", "aaa")])
def test_bm25_matches_the_full_text_index(spark, tokenizer, query):
    rng = random.Random(3)
    words = "the dog dogs running run runs aaaa aaaaa cat over été".split()
    docs = [(f"p{k:03d}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for k in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute(f"CREATE VIRTUAL TABLE t USING fts5(path, content, tokenize='{tokenizer}')")
    db.executemany("INSERT INTO t VALUES (?, ?)", docs)
    want = {p: round(s, 9) for p, s in db.execute("SELECT path, rank FROM t WHERE t MATCH ?", (search.literal_phrase(query),))}
    run = search.search_porter if "porter" in tokenizer else search.search_trigram
    got = {r["path"]: round(r["score"], 9) for r in run(frame(spark, docs, "path string, content string"), query, 100).collect()}
    assert got == pytest.approx(want, abs=1e-8)


def test_search_pipeline(spark):
    docs = [(f"d{k}", ("alpha beta " if k < 3 else "alpha gamma beta ") + "word " * k) for k in range(6)]
    got = search.search(frame(spark, docs, "path string, content string"), "alpha beta", 5).collect()
    assert {r["path"] for r in got} == {"d0", "d1", "d2"} and all("<b>alpha beta</b>" in r["snippet"] for r in got)
    assert search.search(frame(spark, docs, "path string, content string"), "al", 5).count() == 0
    assert search.search(frame(spark, [], "path string, content string"), "alpha", 5).count() == 0


def test_proximity(spark):
    rows = frame(spark, [("a", "<b>x</b> " + "y" * 200, 1), ("b", "<b>x</b>", 2)], "path string, snippet string, i int")
    assert [r["path"] for r in search.proximity_rerank(rows, "two words", [F.col("i")]).collect()] == ["b", "a"]
    assert [r["path"] for r in search.proximity_rerank(rows, "one", [F.col("i")]).collect()] == ["a", "b"]
    got = frame(spark, [("",), ("plain",), ("<b>x</b>",)], "s string").select(search.proximity_density(F.col("s"))).collect()
    assert [r[0] for r in got] == [0.0, 0.0, 12.5]


def test_grep_family(spark):
    files = frame(spark, [("a", "x\nhit 1\ny\nz\nhit 2\n"), ("b", "none"), ("c/.env", "hit"), ("d", "fn hit")], "path string, content string")
    hits = grep.grep(files, "hit")
    assert [(r["path"], r["line_no"]) for r in hits.orderBy("path", "line_no").collect()] == [("a", 2), ("a", 5), ("d", 1)]
    assert [r["line_no"] for r in grep.grep_context(files.filter("path = 'a'"), "hit", 1, 1).orderBy("line_no").collect()] == [1, 2, 3, 4, 5]
    assert grep.grep_context(files, "hit").filter("path = 'c/.env'").count() == 0
    parts = frame(spark, [("a", "1\nhit\n3\n4\n5\n6\nhit\n8"), ("b", "x\nhit\ny")], "path string, content string")
    near = grep.grep_context(parts, "hit", 1, 1)
    taken = lambda n: [(r["path"], r["line_no"]) for r in grep.first_hits(near, n).orderBy("path", "line_no").collect()]
    assert taken(1) == [("a", 1), ("a", 2), ("a", 3)] and taken(2) == [("a", k) for k in (1, 2, 3, 6, 7, 8)]
    assert taken(3) == [*taken(2), ("b", 1), ("b", 2), ("b", 3)] == taken(9)
    groups = grep.with_dirty(grep.group_lines(hits), frame(spark, [("d", "M")], "path string, tag string"))
    assert [(r["path"], r["hits"]) for r in grep.summary(groups).collect()] == [("d", 1), ("a", 2)]
    assert grep.first_lines(hits, 1).filter("path = 'd'").first()["preview"] == "[def] fn hit"
    pages = [r for k in range(3) for r in grep.page(hits, k, 1).collect()]
    assert pages == hits.orderBy("path", "line_no").collect()
    with pytest.raises(ValueError):
        grep.page(hits, 490, 20)


def test_purges(spark):
    t = frame(spark, [(p,) for p in ("session:a", "session:ab", "session:abc", "session:ab:x", "doc", "doc#chunk-1", "doc2", "a_b%c")], "path string")
    left = lambda gone: {r[0] for r in store.purge(t, gone).collect()}
    assert left(store.under_session(F.col("path"), "ab")) == {"session:a", "session:abc", "doc", "doc#chunk-1", "doc2", "a_b%c"}
    assert left(store.document_or_chunk(F.col("path"), "doc")) == {"session:a", "session:ab", "session:abc", "session:ab:x", "doc2", "a_b%c"}
    assert len(left(store.under_prefix(F.col("path"), "a_"))) == 7 and left(store.under_prefix(F.col("path"), "")) == set()
    with pytest.raises(ValueError):
        store.purge_project(t, "kb", "wrong", True)
    assert store.purge_project(t, "kb", "purge project kb", True).count() == 0


def test_upsert_and_chunks(spark):
    t = frame(spark, [("d", "old", 1), ("e#chunk-0", "x", 1), ("e#chunk-1", "y", 1)], "path string, content string, indexed_at long")
    new = frame(spark, [("d", "[def] new", 2), ("s", "AKIA" + "Q" * 16, 2)], "path string, content string, indexed_at long")
    got = {r["path"]: r["content"] for r in store.upsert(t, new).collect()}
    assert got == {"d": " [def] new", "e#chunk-0": "x", "e#chunk-1": "y"}
    assert [r[0] for r in store.refused(new).collect()] == ["s"]
    chunks = frame(spark, [("e", 0, "only", 2), ("d", 0, "ok", 2), ("d", 1, "AKIA" + "Q" * 16, 2)], "document string, chunk_no int, content string, indexed_at long")
    assert {r["path"]: r["content"] for r in store.replace_chunks(t, chunks).collect()} == {"d": "old", "e": "only"}


def test_chunking():
    assert [len(c) for c in ingest.chunk("a" * 10_000)] == [4000, 4000, 2000]
    two = ingest.chunk("界" * 2000)
    assert len(two) == 2 and "".join(two) == "界" * 2000
    assert len(ingest.chunk("s\n\n" + "b" * 9000 + "\n\nt")) == 5
    assert ingest.chunk(" \n\n ") == [" \n\n "] and ingest.chunk("a\n\n\n\nb") == ["a\n\nb"]


def test_markdown():
    got = ingest.markdown("<html><script>x</script><h2>T</h2><p>a <b>b</b> <a href='u'>l</a></p><ul><li>i</li></ul><code>c</code></html>")
    assert "## T" in got and "a **b** [l](u)" in got and "- i" in got and "`c`" in got and "x<" not in got


def test_limiter(spark):
    limiter = usage.Limiter(4, 9)
    assert [limiter.allow(k) for k in range(10)] == ["ok"] * 4 + ["throttled"] * 5 + ["blocked"]
    assert limiter.allow(61_000_000) == "ok"
    rows = frame(spark, [(k, k % 2, k) for k in range(24)], "event_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = usage.limiter_status(rows, "user_id").filter("user_id = 0").orderBy("event_id").collect()
    assert [r["status"] for r in got] == ["ok"] * 4 + ["throttled"] * 5 + ["blocked"] * 3


def test_attempts_exclude_the_bound(spark):
    rows = frame(spark, [(1, 0), (2, 30), (3, 60), (4, 60)], "event_id long, s long").select("event_id", F.lit(1).alias("u"), F.timestamp_seconds("s").alias("ts"))
    assert [r["attempts"] for r in usage.attempts_in_window(rows, ["u"]).orderBy("event_id").collect()] == [0, 1, 1, 1]


def test_rollup(spark):
    rows = frame(spark, [(1, 0, "a", -1, 5, False, True, "x"), (1, 1, "b", 0, 5, True, False, ""), (2, 0, "c", 0, 1, False, False, "")], "run int, idx int, label string, exit_code int, size int, truncated boolean, indexed boolean, error_class string")
    got = {r["run"]: r for r in usage.batch_rollup(rows).collect()}
    assert got[1]["exit_code"] == -1 and got[1]["first_failed"] == "a" and got[1]["truncated"] and got[2]["exit_code"] == 0 and got[2]["first_failed"] is None


def test_sources(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"session_id":"s1","output_len":100,"indexed":true}\n\nnot json\n{"session_id":"s1","output_len":200,"truncated":true}\n{"session_id":"s2","output_len":1}\n')
    log = tables.read_audit(spark, str(tmp_path / "log.jsonl"))
    got = usage.audit_totals(log.filter("session_id = 's1'")).first()
    assert (got["calls"], got["output_len"], got["indexed"], got["truncated"]) == (2, 300, 1, 1)
    status = "R  new.go\x00old.go\x00?? other.go\x00MM m.go\x00x\x00"
    got = {r["path"]: r["tag"] for r in tables.parse_porcelain(frame(spark, [(status,)], "status string")).collect()}
    assert got == {"new.go": "A", "other.go": "??", "m.go": "M"}
    assert tables.scan_files(spark, str(tmp_path)).count() == 1
    assert tables.legacy_documents(frame(spark, [('{"a":"x","":"y","b":null}',), ("bad",)], "json string")).collect()[0]["path"] == "a"


def test_cache(spark):
    c = frame(spark, [("u", 100), ("v", 50)], "key string, fetched_at long")
    assert [r["key"] for r in store.fresh(c, 150, 60).collect()] == ["u"] and store.fresh(c, 150, 0).count() == 0
    assert [r["key"] for r in store.to_backfill(c, frame(spark, [("u#chunk-0",)], "path string")).collect()] == ["v"]


def test_file_intake(spark):
    from lodestone.operators import files

    rows = [("a/x.txt", b"hello"), ("a/.git/y", b"z"), ("b/img.png", b"p"), ("b/.env", b"K=1"), ("c/bin", b"\x00\x01"), ("c/key.txt", b'password = "abcdefgh1"')]
    tree = frame(spark, [(p, c, len(c)) for p, c in rows], "path string, content binary, size long")
    assert [(r["path"], r["content"]) for r in files.index_files(tree, 7).collect()] == [("a/x.txt", "hello")]
    assert {r["path"]: r["reason"] for r in files.skip_reasons(tree).collect()}["b/.env"] == "sensitive path"
    links = frame(spark, [("a", 1, 1, 2), (".ssh/k", 1, 1, 2), ("b", 1, 2, 1)], "path string, dev int, ino int, nlink int")
    assert [r["path"] for r in files.not_linked_to_secrets(links).collect()] == ["b"]
    shown, more = files.capped_scan(tree, 2)
    assert more and shown.count() == 2
    lines = frame(spark, [("a/b.go:12:x:1",), ("--",), ("engine=go matches=1",)], "l string")
    got = [tuple(r) for r in lines.select(*files.parse_match_line(F.col("l")).values()).collect()]
    assert got == [("a/b.go", 12, "x:1"), (None, None, None), (None, None, None)]
    assert [r["path"] for r in files.dirty_first(frame(spark, [("a.go",), ("b.go",), ("c.md",)], "path string"), frame(spark, [("b.go", "M")], "path string, tag string"), "*.go").collect()] == ["b.go", "a.go"]


def test_results_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.concat("source", F.lit(":"), "doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    one, many = docs.coalesce(1), docs.repartition(8)
    for make in (lambda d: search.search_trigram(d, "the on"), lambda d: search.search_porter(d, "the"), lambda d: grep.group_lines(grep.grep(d, "ing the")), lambda d: ingest.chunk_documents(d)):
        assert sorted(map(str, make(one).collect())) == sorted(map(str, make(many).collect()))


def test_registry_is_complete():
    from lodestone.plans import registry

    queries, sql = registry.queries(), registry.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) >= 90


def test_whole_texts_lines_values_and_tiers(spark, tmp_path):
    from lodestone.functions import text
    from lodestone.plans import line_queries as q

    long = "x" * 50 + "\x1b[31mred\x1b[0m " + "y" * 50
    frame(spark, [(k, t, "en", "s", 0) for k, t in enumerate([long, "\n" + " " * 30 + "name", None])], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(q.strip_ansi(spark, str(tmp_path)).collect())
    assert got == {0: "x" * 50 + "red " + "y" * 50 + "--end", 1: "\n" + " " * 30 + "name--end", 2: "--end"}
    got = dict(q.grep_definitions(spark, str(tmp_path)).collect())
    assert got["s:markdown:1"] == 1  # "  class ", blanks and a name behind 20 characters
    assert {r["score"] for r in q.resolve_fuzzy(spark, str(tmp_path)).collect()} == {95.0}
    frame(spark, [(f"src/p{k}/m_a_i_n.g_o",) for k in range(3)] + [("main.go",), ("xmain.go",), ("main.gox",), ("a/main.go/b",), ("zz",)], "path string").createOrReplaceTempView("tiers")
    q_paths, q._paths = q._paths, lambda s, sf: s.table("tiers")
    try:
        got = [r["path"] for r in q.resolve_fuzzy(spark, "").collect()]
    finally:
        q._paths = q_paths
    assert got[:4] == ["main.go", "xmain.go", "main.gox", "a/main.go/b"] and len(got) == 7
    sf = "/root/testdata/sf0.001"
    values = {r["event_id"]: int(r["value"] or 0) * (r["event_id"] % 5 * r["event_id"] * 37 + 1) for r in spark.read.parquet(f"{sf}/events.parquet").collect()}
    got = {r["event_id"]: (r["bytes"], r["tokens"]) for r in q.human_sizes(spark, sf).collect()}
    scaled = lambda n, units: next((f"{n / k:.1f}{u}" for k, u in units if n >= k), None)
    assert got == {i: (scaled(n, [(1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB")]) or f"{n}B", scaled(n, [(10**6, "M"), (1000, "K")]) or str(n)) for i, n in values.items()}
    ties = frame(spark, [(1280,), (1150,), (1450,)], "n long").select(text.human_bytes(F.col("n")), text.human_tokens(F.col("n"))).collect()
    assert [tuple(r) for r in ties] == [("1.2KB", "1.3K"), ("1.1KB", "1.1K"), ("1.4KB", "1.4K")]


def test_snippet_window_is_the_best_of_all(spark, tmp_path):
    from lodestone.functions.stem import raw_tokens
    from lodestone.plans import search_queries as q

    sparse = ("hit " + "w " * 300) * 60
    text = sparse + "hit " * 9 + "w " * 300
    got = frame(spark, [(text,)], "t string").select(search.snippet("hit", True)("t"), search.snippet("hit", False)("t")).first()
    assert got[0].count("<b>") == 9 and got[1].count("<b>") == 9
    rng = random.Random(5)
    for _ in range(200):
        t = "".join(rng.choice(["ab", "b", "a", " ", " ", ", "]) for _ in range(60))
        words, needle, size = raw_tokens(t), rng.choice(["ab", "b a", "a", " a"]), rng.randint(1, 6)
        spans = [(k, k + len(needle)) for k in range(len(t)) if t.startswith(needle, k)]
        if len(words) <= size:
            continue
        counts = [sum(words[k][1] <= s and e <= words[k + size - 1][2] for s, e in spans) for k in range(len(words) - size + 1)]
        assert counts[search.best_window(words, spans, size)] == max(counts)
    docs = [(0, "w " * 300 + q.NEEDLE, "en", "s", 0), (1, "other words", "en", "s", 0), (2, "more words " + q.NEEDLE + " w" * 600, "en", "s", 0)]
    frame(spark, docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r["boosted"] for r in q.kb_search_proximity_snippet(spark, str(tmp_path)).collect()]
    assert len(got) == 2 and all(b % 1 > 0 for b in got)  # a hit behind 200 characters counts


def test_whole_texts_reach_python_by_rows(spark):
    """In Arrow batches a worker held ten thousand whole texts, and what it made of them, at once."""
    docs = spark.createDataFrame([("a", "alpha beta", 200, "text/html", "<p>alpha</p>", "")], "path string, content string, status int, content_type string, body string, format string")
    for made in (ingest.chunk_documents(docs), ingest.response_texts(docs)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan and made.count() == 1
    assert [r["tf"] for r in search.search_porter(docs, "alpha beta").collect()] == [1]


def test_fnv_reads_texts_where_they_lie():
    texts = pa.array(["x", "", None, "foobar", "界" * 3, "a" * 500])
    for part in (texts, texts.slice(2, 3), texts.slice(0, 0)):
        assert text.fnv64.func(part).to_pylist() == [None if x is None else text.fnv1a64(x.encode()) for x in part.to_pylist()]


def test_stemmed_search_counts_by_rows(spark, monkeypatch):
    seen, real = [], search._ranked_once
    monkeypatch.setattr(search, "_ranked_once", lambda docs, scored, *more: seen.append(scored) or real(docs, scored, *more))
    docs = spark.createDataFrame([("a/dog", "the dogs ran"), ("b", None), (None, "dog dog")], "path string, content string")
    got = search.search_porter(docs.filter("path IS NOT NULL"), "dog").collect()
    assert [(r["path"], r["tf"], r["length"]) for r in got] == [("a/dog", 2, 5)]
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython") == 1 and "InPandas" not in plan
