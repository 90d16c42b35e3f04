"""The index against searches of the texts themselves, and the guarded pipeline."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import index, search, store, usage
from lodestone.sources import shared

WORDS = "the dog dogs running run runs a a a cat over été the_dog ĀB".split()


def some_documents(seed, n, prefix="p"):
    rng = random.Random(seed)
    return [(f"{prefix}/{rng.choice(WORDS)}/{k:03d}", None if k == 5 else "".join(rng.choice([*WORDS, "aaaa", " "]) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(0, 40)))) for k in range(n)]


def keep(df):
    return [(r["path"], r["tf"], r["length"], round(r["score"], 9)) for r in df.collect()]


def same(spark, folder, docs, queries, limit=100, prefix=None):
    for q in queries:
        assert keep(index.search_index(spark, folder, q, limit, prefix)) == keep(search.search_porter(docs, q, limit, prefix)), q
        assert keep(index.search_substring(spark, folder, q, limit, prefix)) == keep(search.search_trigram(docs, q, limit, prefix)), q


def test_index_equals_the_plain_search(spark, tmp_path):
    docs, folder = spark.createDataFrame(some_documents(4, 60), "path string, content string"), f"{tmp_path}/i"
    v = index.build(docs.repartition(3), folder)
    assert v.docs == 60 and index.current(spark, folder) == v and v.grams > 0
    same(spark, folder, docs, ("running dogs", "a a", "aaa", "the dog run", "nothing", "", "p cat", "āb", "TÉ", "al"))
    same(spark, folder, docs, ("dog",), 9, "p/c")
    many = index.search_many(spark, folder, ["dog", "cat", "dog"], 2).collect()
    assert [(r["query"], r["path"]) for r in many] == [(q, r["path"]) for q in ("cat", "dog") for r in search.search_porter(docs, q, 2).collect()]
    with pytest.raises(ValueError):
        index.search_many(spark, folder, [f"w{k}" for k in range(21)])
    with pytest.raises(FileNotFoundError):
        index.current(spark, f"{tmp_path}/none")
    a, b = (search.search(docs, "dog", 5, index=i).collect() for i in (None, folder))
    assert a == b and a


def test_upkeep_equals_a_new_index(spark, tmp_path):
    """Upserts, deletes, replaced documents and merges against the table that ``store`` makes of the same writes."""
    folder, schema = f"{tmp_path}/i", "path string, content string, indexed_at long"
    table = spark.createDataFrame([(p, c or "", 1) for p, c in some_documents(7, 40)], schema)
    index.build(table, folder)
    paths = [r["path"] for r in table.orderBy("path").collect()]
    new = spark.createDataFrame([(paths[0], "dog cat", 2), (paths[0], "older dog", 1), (paths[1], "AKIA" + "Q" * 16, 2), ("p/new", "the dog ran over a cat", 2), (paths[3], "", 2), (paths[4], "[def] dog", 2)], schema)
    index.upsert(spark, folder, new)
    table = store.upsert(table, new.filter("content <> 'older dog'"))
    index.delete(spark, folder, F.col("path").isin(paths[6], paths[7]))
    table = table.filter(~F.col("path").isin(paths[6], paths[7]))
    chunks = spark.createDataFrame([(paths[8], 0, "dog one", 3), (paths[8], 1, "dog two", 3), (paths[9], 0, "only dog", 3), (paths[10], 0, "fine", 3), (paths[10], 1, "ghp_" + "a" * 36, 3)], "document string, chunk_no int, content string, indexed_at long")
    index.replace(spark, folder, chunks)
    table = store.replace_chunks(table, chunks)
    again = spark.createDataFrame([(paths[0], "dog dog", 4)], schema)
    index.upsert(spark, folder, again)
    table = store.upsert(table, again).select("path", "content", "indexed_at")
    table = spark.createDataFrame(table.collect(), schema)
    queries = ("dog", "the dog", "a a", "aaa", "run")
    for step in (lambda: None, lambda: index.merge(spark, folder), lambda: index.vacuum(spark, folder)):
        step()
        live, v = index.documents(spark, folder), index.current(spark, folder)
        assert sorted(map(tuple, live.select("path", "content", "indexed_at").collect())) == sorted(map(tuple, table.collect()))
        assert (v.docs, v.words, v.grams) == tuple(live.agg(F.count("*"), F.sum("words"), F.sum("grams")).first())
        same(spark, folder, table, queries)
    assert len(v.segments) == 1 and shared.child_names(spark, f"{folder}/segments") == [v.segments[0][1]]
    index.delete(spark, folder, F.lit(True))
    assert index.current(spark, folder).docs == 0 and keep(index.search_substring(spark, folder, "dog")) == []
    index.merge(spark, folder)
    assert index.documents(spark, folder).count() == 0 and keep(index.search_index(spark, folder, "dog")) == []


def test_empty_index(spark, tmp_path):
    index.build(spark.createDataFrame([], "path string, content string"), f"{tmp_path}/i")
    assert keep(index.search_index(spark, f"{tmp_path}/i", "dog")) == [] and keep(index.search_substring(spark, f"{tmp_path}/i", "dog")) == []
    index.upsert(spark, f"{tmp_path}/i", spark.createDataFrame([("a", "dog", 1)], "path string, content string, indexed_at long"))
    assert [r[:2] for r in keep(index.search_index(spark, f"{tmp_path}/i", "dogs"))] == [("a", 1)]


def test_only_the_folders_of_the_terms_are_read(spark, tmp_path):
    docs = spark.createDataFrame(some_documents(4, 30), "path string, content string")
    v = index.build(docs, f"{tmp_path}/i")
    plan = index.substring_hits(spark, f"{tmp_path}/i", "dog r", v)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [" in plan and "docs" not in plan.split("Location")[1][:200]


def test_places_are_kept_in_little_more_than_a_byte():
    rng = np.random.default_rng(5)
    for spread in (1, 3, 50, 10_000):
        lists = [np.sort(rng.choice(spread * n + 5, n, replace=False)) for n in rng.integers(1, 300, 40)] + [np.array([0]), np.array([2**31 + 7]), np.arange(9), np.array([0, 1, 2, 1_000_000])]
        counts = np.array([len(x) for x in lists])
        bits, edges, data = index.encode(np.concatenate(lists), counts)
        for k, x in enumerate(lists):
            assert index.decode(len(x), int(bits[k]), data[edges[k] : edges[k + 1]].tobytes()).tolist() == x.tolist()
            assert (edges[k + 1] - edges[k]) * 8 <= len(x) * (np.log2(max(1, x[-1] / len(x))) + 4) + 16


def test_a_posting_is_a_row_per_term_and_block(spark, tmp_path):
    """Long documents, over several blocks: a row per document and term, each with its path, made the shuffle many times the texts."""
    texts = [(f"d/{k:02d}", " ".join(random.Random(k).choices(WORDS[:9], k=2000))) for k in range(60)] + [("long/1", "cat over " * 150_000), ("long/2", None), ("long/3", "the cat")]
    docs, folder = spark.createDataFrame(texts, "path string, content string").coalesce(1), f"{tmp_path}/i"
    v = index.build(docs, folder)
    where = f"{folder}/segments/{v.segments[0][1]}"
    placed = spark.read.parquet(f"{where}/docs")
    assert placed.select("block").distinct().count() == 3
    for kind, total in (("words", v.words), ("grams", v.grams)):
        rows = spark.read.parquet(f"{where}/{kind}")
        assert rows.count() == rows.select("term", "block").distinct().count() and rows.agg(F.sum("n")).first()[0] == total
        assert "path" not in rows.columns and rows.agg(F.sum(F.octet_length("data"))).first()[0] < 1.5 * total
    same(spark, folder, docs, ("cat over", "over cat", "the dog", "at o", "t over c"))


def test_cover():
    rng = random.Random(2)
    for _ in range(200):
        counts = [rng.randrange(9) for _ in range(rng.randint(1, 8))]
        n = len(counts) + 2
        got = index.cover(counts)
        covers = lambda places: len({c for p in places for c in range(p, p + 3)}) == n
        best = min(sum(counts[k] for k in x) for m in range(1, len(counts) + 1) for x in itertools.combinations(range(len(counts)), m) if covers(x))
        assert covers(got) and sum(counts[k] for k in got) == best


def lists_of(spark, rows):
    docs = spark.createDataFrame(rows, "path string, content string")
    return docs, search.plain_lists(docs, "alpha beta", None)


def broken(n):
    raise search.PySparkException("list is gone\nmore")


def test_guard_and_error_policy(spark):
    docs, good = lists_of(spark, [(f"d{k}", "alpha beta " + "word " * k) for k in range(8)])
    _, none = lists_of(spark, [("d", "nothing here")])
    found, meta = search.guarded_search(spark, "alpha beta", good, 6)
    assert found.count() == 6 and meta.first().asDict(True) == {"flood_status": "ok", "corrected": False, "total_hits": 6, "failures": [], "error": None}
    found, meta = search.guarded_search(spark, "alpha beta", (broken, broken), 6, "blocked")
    assert found.count() == 0 and meta.first()["error"] == search.BLOCKED and meta.first()["failures"] == []
    found, meta = search.guarded_search(spark, "alpha beta", good, 6, "throttled")
    assert found.count() == 3 and meta.first()["flood_status"] == "throttled"
    assert search.guarded_search(spark, "alpha beta", good, 1, "throttled")[0].count() == 1
    for lists, failed in (((good[0], broken), ["parts"]), ((broken, good[1]), ["words"])):
        found, meta = search.guarded_search(spark, "alpha beta", lists, 6)
        assert found.count() == 6 and meta.first()["error"] is None and [x["list"] for x in meta.first()["failures"]] == failed
    for lists in ((none[0], broken), (broken, none[1])):
        found, meta = search.guarded_search(spark, "alpha beta", lists, 6)
        assert found.count() == 0 and meta.first()["error"] == "list is gone"
    found, meta = search.guarded_search(spark, "alpha beta", (broken, broken), 6)
    assert meta.first()["error"] == "list is gone; list is gone" and len(meta.first()["failures"]) == 2
    with pytest.raises(RuntimeError):
        search.search(docs, "alpha beta", status="blocked")


def test_failure_inside_spark_is_a_row(spark):
    _, good = lists_of(spark, [(f"d{k}", "alpha beta") for k in range(3)])
    bad = lambda n: spark.range(3).select(F.col("id").cast("string").alias("path"), F.lit("x").alias("content"), F.raise_error(F.lit("disk")).cast("double").alias("score"))
    found, meta = search.guarded_search(spark, "alpha beta", (good[0], bad), 6)
    assert found.count() == 3 and meta.first()["failures"][0]["list"] == "parts"


def test_scopes(spark):
    rows = [("session:s:rg:1", "alpha beta"), ("rg:1", "alpha beta"), ("batch:r1:x", "alpha beta"), ("batch:r2:x", "alpha beta"), ("other", "alpha beta")]
    docs = spark.createDataFrame(rows, "path string, content string")
    of = lambda df: {r["path"] for r in df.collect()}
    assert of(search.search_lines(docs, "alpha", "s")) == {"session:s:rg:1"} and of(search.search_lines(docs, "alpha", None)) == {"rg:1"}
    assert of(search.search_batch(docs, "alpha", "r1")) == {"batch:r1:x"} and of(search.search_batch(docs, "alpha")) == {"batch:r1:x", "batch:r2:x"}


def test_next_status(spark):
    calls = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts FROM range(5)")
    assert usage.next_status(calls.limit(0), "2024-01-01 00:00:10") == "ok" and usage.next_status(calls, "2024-01-01 00:00:10") == "throttled"
    assert usage.next_status(calls, "2024-01-01 00:02:00") == "ok" and usage.next_status(calls, "2024-01-01 00:00:10", "rg") == "ok"
    assert usage.next_status(calls.union(calls), "2024-01-01 00:00:10") == "blocked"
