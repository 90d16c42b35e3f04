import re

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = docs.limit(5).selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars")
    blank = spark.createDataFrame([(900000, "123 456", None, None, None), (900001, None, None, None, None)], docs.schema)
    now = docs.union(copies).union(blank)
    gone = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == docs.columns
        kept = {r[0] for r in after.select("doc_id").collect()}
        gone.append({r[0] for r in now.select("doc_id").collect()} - kept)
        now = spark.createDataFrame(after.collect(), docs.schema)
    assert {900000, 900001} <= gone[0] and len(gone[0]) <= 4 and len(gone[1]) >= 5
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).select("doc_id").distinct().count() == now.count()


def test_repeated_rows_and_nulls(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, "a bc", "en", None, 4), (None, "other", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.exact_stage(spark, docs, SF)
    assert sorted(r["text"] or "" for r in kept.collect()) == ["", "a b c", "other"]
    assert corpus_pipeline.near_stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.near_stage(spark, kept, SF).count() == 3


def test_near_stage_decides_per_row(spark):
    words = lambda tag: " ".join(f"{tag}{k}" for k in range(60))
    a, b, c, d = map(words, "abcd")
    rows = [
        (3, b), (None, b + " tail"), (None, "clean one"), (None, None),  # a row without an id is a near copy of 3
        (5, "unique five"), (5, b + " end"),  # of a repeated id one row is a near copy of 3
        (6, a), (6, a + " more"), (7, a + " last"),  # near copies under one id
        (8, "same text"), (8, "same text"), (9, None), (9, None),  # repeated rows; without shingles
        (None, c), (None, c + " x"), (None, d), (None, d),  # groups without any id: one row of each stays
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    out = corpus_pipeline.near_stage(spark, docs, SF)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sum(i == 6 for i, _ in got) == 1 and {t for i, t in got if i == 6} <= {a, a + " more"}
    without = [t for i, t in got if i is None and t and t[0] == "c" and t[1].isdigit()]
    assert len(without) == 1 and without[0] in (c, c + " x")
    rest = [(3, b), (None, "clean one"), (None, None), (5, "unique five"), (8, "same text"), (9, None), (9, None), (None, d)]
    assert sorted(map(str, (r for r in got if r[0] != 6 and r != (None, without[0])))) == sorted(map(str, rest))


def test_stages_take_empty_tables_clashing_names_and_long_texts(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, ambiguous boolean, _row int, _key int, _copy string, id long"
    long = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}" for k in range(60_000))
    texts = ["the cat and the dog went home", "der hund und die katze", "the cat and the dog went home", long, long + " end"]
    for ids in ([1, 2, 3, 6, 7], [1, 1, 3, None, None]):
        rows = [(i, t, "de" if "hund" in t else "en", None, None, -7.0, "mine", None, 5, None, "c", 9) for i, t in zip(ids, texts, strict=True)]
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert stage(spark, docs.limit(0), SF).collect() == []
            if name == "packing":
                assert {r["doc_id"] for r in out.collect()} == set(ids)
                continue
            assert out.columns == docs.columns
            kept = out.collect()
            assert {(r["score"], r["lang_pred"], r["ambiguous"], r["_row"], r["_key"], r["_copy"], r["id"]) for r in kept} == {(-7.0, "mine", None, 5, None, "c", 9)}
            assert len(kept) == {"language_id": 5, "exact_dedup": 4, "jaccard_join": 3 if ids[1] == 2 else 3}[name]


def test_run_equals_its_stages(spark):
    """The rows of run() are those of a plain reading of the rules: kept languages, exact and near groups, and every token once."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF).collect()
    named = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, SF).collect()}
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] in named}
    groups: dict[str, list] = {}
    for i, t in rows.items():
        groups.setdefault(re.sub(r"[ \t-\r]", "", t), []).append((-len(t), i))
    kept = sorted(min(g)[1] for g in groups.values())
    words = {i: re.findall(r"[^ \t-\r]+", rows[i].translate({c: c + 32 for c in range(65, 91)})) for i in kept}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    comp = {i: i for i in kept}
    for i in kept:  # ascending, so the least id leads
        for j in kept:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                lo, hi = sorted((comp[i], comp[j]))
                comp = {k: lo if v == hi else v for k, v in comp.items()}
    stay = {i for i in kept if comp[i] == i}
    assert {r["doc_id"] for r in got} == stay
    total: dict[int, int] = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert all(total[r["doc_id"]] == r["doc_tokens"] for r in got)
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    assert all(a[0] == b[0] and a[1] + a[2] == b[1] or b[1] == 0 and a[1] + a[2] == 1024 for a, b in zip(spans, spans[1:]))
