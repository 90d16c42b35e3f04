"""Registered queries: search, ranking, store and ingestion. Each has SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gates, text
from ..operators import index, ingest, search, store
from ..sources.shared import delete_folder, listing_mark, new_folder
from ..sources.tables import generations, kb_documents, table

NEEDLE = "tion the"
SECOND = "and ther"
#: The clock of all cache queries, in seconds.
NOW = 1_000_000
#: Credential shapes that a fifth of the documents of ``leaky`` get, made up from repeated characters.
LEAKS = [
    "AKIA" + "Q" * 16, "ghp_" + "a" * 36, "xoxb-" + "1" * 12, 'api_key = "' + "x" * 16 + '"', "password: 'abcdefgh'", "-----BEGIN RSA PRIVATE KEY-----", "eyJh.eyJz.c2ln",
    "AKIA" + "Q" * 15, 'my_password = "abcdefgh"',
]


def leaky(spark: SparkSession, sf: str) -> DataFrame:
    """kb_documents with doc_id; every fifth document ends in a line that is or resembles a credential."""
    d = table(spark, sf, "documents")
    line = F.element_at(F.array(*[F.lit(x) for x in LEAKS]), (F.floor(F.col("doc_id") / 5) % len(LEAKS) + 1).cast("int"))
    content = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("\n"), line)).otherwise(""))
    return d.select(F.concat_ws(":", "source", F.lit("markdown"), F.col("doc_id").cast("string")).alias("path"), content.alias("content"), "doc_id")


_LEAK_LIST = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in LEAKS) + "]"
LEAKY_SQL = f"""leaky AS (SELECT source || ':markdown:' || doc_id AS path, doc_id, coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN chr(10) || {_LEAK_LIST}[doc_id // 5 % {len(LEAKS)} + 1] ELSE '' END AS content FROM documents)"""


def secret_sql(c: str) -> str:
    """Whether a text holds a secret, in SQL."""
    word = lambda p: f"regexp_matches({c}, '\\b{p}\\b')"
    banners = " OR ".join(f"contains({c}, '{b}')" for b in gates.PRIVATE_KEY_BANNERS)
    assigned = " OR ".join("regexp_matches(" + c + ", '" + p.replace("'", "''") + "')" for p in (gates.ASSIGNED_SECRET, gates.ASSIGNED_PASSWORD))
    return f"({banners} OR {word(gates.AWS_KEY)} OR {word(gates.GITHUB_TOKEN)} OR {word(gates.SLACK_TOKEN)} OR {word(gates.JWT)} OR {assigned})"


def head_sql(t: str, limit: int) -> str:
    """The longest prefix of at most ``limit`` bytes, in SQL."""
    most = f"list_max(list_filter(range(greatest(0, least(length({t}), {limit}) - (strlen(left({t}, {limit})) - {limit})), {limit + 1}), lambda k: strlen(left({t}, k)) <= {limit}))"
    return f"(CASE WHEN strlen({t}) <= {limit} THEN {t} ELSE left({t}, {most}) END)"


_KB = "SELECT source || ':markdown:' || doc_id AS path, coalesce(text, '') AS c, doc_id, source FROM documents"
_SCOPED = "SELECT CASE WHEN doc_id % 2 = 1 THEN 'batch:' || source || ':' ELSE 'session:' || source || ':rg:' END || doc_id AS path, coalesce(text, '') AS content FROM documents"


def _bm25_sql(needle: str, prefix: str = "", limit: int = 20, kb: str = "SELECT source || ':markdown:' || doc_id AS path, coalesce(text, '') AS content FROM documents") -> str:
    """Substring BM25 over path and content; the needle does not overlap itself."""
    n = len(needle)
    occ = lambda c: f"(length({c}) - length(replace({c}, '{needle}', ''))) // {n}"
    return f"""
    kb AS ({kb}),
    t AS (SELECT path, content, {occ("lower(content)")} + {occ("lower(path)")} AS tf,
          greatest(0, length(content) - 2) + greatest(0, length(path) - 2) AS length FROM kb),
    st AS (SELECT count(*) AS n, count(*) FILTER (WHERE tf > 0) AS hits, avg(length) AS mean FROM t),
    hit AS (SELECT path, content, tf, length,
            -(CASE WHEN ln((n - hits + 0.5) / (hits + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - hits + 0.5) / (hits + 0.5)) END)
            * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS score FROM t, st
            WHERE tf > 0 AND starts_with(path, '{prefix}') ORDER BY score, path LIMIT {limit})"""


def _scored(hits: DataFrame) -> DataFrame:
    return hits.select("path", "tf", "length", F.round("score", 6).alias("score"))


def kb_search_trigram_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(search.search_trigram(kb_documents(spark, sf), NEEDLE))


def kb_search_prefix_scope(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(search.search_trigram(kb_documents(spark, sf), NEEDLE, prefix="src1"))


def kb_search_porter_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(search.search_porter(kb_documents(spark, sf), "the thing"))


def _list(spark: SparkSession, sf: str, needle: str) -> DataFrame:
    return search.with_rank(search.search_trigram(kb_documents(spark, sf), needle, 30).withColumn("snippet", F.lit(needle)))


def kb_search_rrf(spark: SparkSession, sf: str) -> DataFrame:
    out = search.rrf_merge(_list(spark, sf, NEEDLE), _list(spark, sf, SECOND))
    return out.select("path", "snippet", F.round("score", 8).alias("score"))


def kb_search_fuzzy_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the fallback fires, for the counts of two lists."""
    a, b = _list(spark, sf, NEEDLE), _list(spark, sf, SECOND)
    n = a.agg(F.count("*").alias("words")).crossJoin(F.broadcast(b.agg(F.count("*").alias("parts"))))
    fused = search.rrf_merge(a, b).agg(F.count("*").alias("fused"))
    return n.crossJoin(F.broadcast(fused)).select("words", "parts", "fused", ((F.col("fused") < 2) & (F.col("parts") > F.col("words"))).alias("corrected"))


def kb_search_proximity(spark: SparkSession, sf: str) -> DataFrame:
    """Re-ranking of a list with whole texts as snippets, the needle marked."""
    hits = search.search_trigram(kb_documents(spark, sf), NEEDLE)
    marked = hits.withColumn("snippet", F.replace("content", F.lit(NEEDLE), F.lit(f"<b>{NEEDLE}</b>")))
    return search.proximity_rerank(marked, NEEDLE, [F.col("score"), F.col("path")]).select("path", F.round("boosted", 6).alias("boosted"))


def kb_search_proximity_snippet(spark: SparkSession, sf: str) -> DataFrame:
    """Re-ranking of a list by its snippets, which are taken from whole texts; SQL cannot express them."""
    marked = search.search_trigram(kb_documents(spark, sf), NEEDLE).withColumn("snippet", search.snippet(NEEDLE, False)(F.col("content")))
    return search.proximity_rerank(marked, NEEDLE, [F.col("score"), F.col("path")]).select("path", F.round("boosted", 6).alias("boosted"))


PHRASE = "the thing"
#: The words of PHRASE with the endings -s, -es, -ed and -ing that the stemmer takes off.
SAME_STEM = {"the": ["the", "thes"], "thing": ["thing", "things", "thinges", "thinged", "thinging"]}
_indexes: dict[tuple[str, str], tuple[str, str]] = {}


def _index(spark: SparkSession, sf: str) -> str:
    """The folder of the documents' index, built once per application and state of the table's files."""
    key, mark = (spark.sparkContext.applicationId, sf), listing_mark(spark, f"{sf}/documents.parquet")
    known = _indexes.get(key)
    if known is None or known[0] != mark:
        folder = new_folder(spark, "index")
        index.build(kb_documents(spark, sf), folder)
        if known is not None:
            delete_folder(spark, known[1])
        _indexes[key] = (mark, folder)
    return _indexes[key][1]


def kb_search_index(spark: SparkSession, sf: str) -> DataFrame:
    """The stemmed list from the postings index."""
    return _scored(index.search_index(spark, _index(spark, sf), PHRASE))


def kb_search_index_many(spark: SparkSession, sf: str) -> DataFrame:
    out = index.search_many(spark, _index(spark, sf), [PHRASE, "the", "thing the"], 5)
    return out.select("query", "path", "tf", "length", F.round("score", 6).alias("score"))


def kb_search_substring_index(spark: SparkSession, sf: str) -> DataFrame:
    """The substring list from the trigrams of the index."""
    return _scored(index.search_substring(spark, _index(spark, sf), NEEDLE))


def kb_search_substring_index_many(spark: SparkSession, sf: str) -> DataFrame:
    out = index.search_many(spark, _index(spark, sf), [NEEDLE, SECOND, "is the on"], 5, stemmed=False)
    return out.select("query", "path", F.round("score", 6).alias("score"))


def kb_index_upkeep(spark: SparkSession, sf: str) -> DataFrame:
    """Phrase and substring lists after upserts, deletes, a replaced document and a merge of the index, over all documents."""
    folder, kb = new_folder(spark, "upkeep"), kb_documents(spark, sf)
    index.build(kb, folder)
    number = F.regexp_extract("path", r"(\d+)$", 1).cast("long")
    for k, (part, head) in enumerate(((0, 600), (1, 300))):  # of some documents the first characters, twice of none
        new = kb.filter(number % 5 == part).select("path", F.left("content", F.lit(head)).alias("content"), F.lit(k + 1).cast("long").alias("indexed_at"))
        index.upsert(spark, folder, new)
    index.delete(spark, folder, store.under_prefix(F.col("path"), "src1:") & (number % 3 == 0))
    pieces = kb.filter(number % 10 == 2).select(F.col("path").alias("document"), "content", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_no"))
    cut = F.when(F.col("chunk_no") == 0, F.left("content", F.lit(400))).otherwise(F.substring("content", 401, 200))
    index.replace(spark, folder, pieces.select("document", "chunk_no", cut.alias("content"), F.lit(3).cast("long").alias("indexed_at")))
    lists = lambda: index.search_substring(spark, folder, NEEDLE, 30).withColumn("kind", F.lit("part")).unionByName(index.search_index(spark, folder, PHRASE, 30).withColumn("kind", F.lit("phrase")))
    before = lists().select("kind", "path", "tf", "length", F.round("score", 6).alias("score"), F.lit(False).alias("merged"))
    rows = before.collect()  # 60 at most
    index.merge(spark, folder)
    index.vacuum(spark, folder)
    return lists().select("kind", "path", "tf", "length", F.round("score", 6).alias("score"), F.lit(True).alias("merged")).unionByName(spark.createDataFrame(rows, before.schema))


def kb_search_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Substring lists within one batch run, and within one session's line searches, by the scores of the whole table."""
    d = table(spark, sf, "documents")
    odd = F.col("doc_id") % 2 == 1
    path = F.when(odd, F.concat(F.lit("batch:"), "source", F.lit(":"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("session:"), "source", F.lit(":rg:"), F.col("doc_id").cast("string")))
    kb = d.select(path.alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    of = lambda name, prefix: _scored(search.search_trigram(kb, NEEDLE, 10, prefix)).withColumn("scope", F.lit(name))
    return of("batch", search.batch_prefix("src1")).unionByName(of("lines", search.line_search_prefix("src2")))


def kb_search_index_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """As kb_search_pipeline, with both lists from the index."""
    return search.search(kb_documents(spark, sf), PHRASE, index=_index(spark, sf)).select("path", "snippet", F.round("score", 6).alias("score"), "corrected")


def kb_search_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(kb_documents(spark, sf), "the thing").select("path", "snippet", F.round("score", 6).alias("score"), "corrected")


def kb_multi_query(spark: SparkSession, sf: str) -> DataFrame:
    queries = spark.createDataFrame([(q,) for q in (NEEDLE, SECOND, "is the on")], "query string")
    return search.search_many(kb_documents(spark, sf), queries).select("query", "path", F.round("score", 6).alias("score"))


def kb_list(spark: SparkSession, sf: str) -> DataFrame:
    return kb_documents(spark, sf).select("path", F.octet_length("content").cast("long").alias("bytes"))


def kb_get(spark: SparkSession, sf: str) -> DataFrame:
    return kb_documents(spark, sf).filter(F.col("path") == "src7:markdown:7")


def kb_stats(spark: SparkSession, sf: str) -> DataFrame:
    kb = kb_documents(spark, sf)
    return kb.agg(F.count("*").alias("documents"), F.sum(F.octet_length("content")).alias("bytes"))


def kb_health_parity(spark: SparkSession, sf: str) -> DataFrame:
    kb = kb_documents(spark, sf)
    return store.health(kb, kb.filter(F.octet_length("content") > 100))


def first_index_token(spark: SparkSession, sf: str) -> DataFrame:
    return kb_documents(spark, sf).select("path", text.first_index_token(F.col("content")).alias("token"))


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    path = F.concat(F.lit("session:"), "source", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit(":run:"), F.col("doc_id").cast("string"))))
    return d.select(path.alias("path"), "doc_id")


SESSIONS_SQL = "WITH s AS (SELECT 'session:' || source || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ':run:' || doc_id END AS path, doc_id FROM documents) "


def purge_session(spark: SparkSession, sf: str) -> DataFrame:
    return store.purge(_sessions(spark, sf), store.under_session(F.col("path"), "src1"))


def purge_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return store.purge(_sessions(spark, sf), store.under_prefix(F.col("path"), "session:src1"))


def purge_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    return store.purge_counts(_sessions(spark, sf), store.under_session(F.col("path"), "src1"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    path = F.concat_ws(":", "source", F.lit("x"), F.floor(F.col("doc_id") / 3).cast("string"))
    return d.select(F.when(F.col("doc_id") % 3 == 0, path).otherwise(F.concat(path, F.lit("#chunk-"), (F.col("doc_id") % 3).cast("string"))).alias("path"), "doc_id")


CHUNKS_SQL = (
    "WITH c AS (SELECT source || ':x:' || (doc_id // 3) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '#chunk-' || (doc_id % 3) END AS path, doc_id FROM documents) "
)


def purge_exact_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return store.purge(_chunks(spark, sf), store.document_or_chunk(F.col("path"), "src7:x:2"))


def documents_of_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).groupBy(store.base_path(F.col("path")).alias("document")).agg(F.count("*").alias("chunks"))


def purge_legacy(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(F.concat(F.lit("web:"), "url").alias("path"), "page_id")
    return store.delete_legacy_fetches(pages.unionByName(_sessions(spark, sf).select("path", F.col("doc_id").alias("page_id"))), "web")


def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    kb = kb_documents(spark, sf).withColumn("indexed_at", F.lit(1).cast("long"))
    new = kb.filter(F.octet_length("content") > 1000).select("path", F.left("content", F.lit(50)).alias("content"), F.lit(2).cast("long").alias("indexed_at"))
    return store.upsert(kb, new)


def replace_chunks(spark: SparkSession, sf: str) -> DataFrame:
    kb = kb_documents(spark, sf).select("path", "content", F.lit(1).cast("long").alias("indexed_at"))
    part = F.floor(F.octet_length("content") / 2000).cast("int")
    chunks = kb.filter(F.col("path").startswith("src3:")).select(F.col("path").alias("document"), F.explode(F.sequence(F.lit(0), F.least(part, F.lit(2)))).alias("chunk_no"), "content")
    chunks = chunks.select("document", "chunk_no", F.concat(F.col("chunk_no").cast("string"), F.lit(":"), F.left("content", F.lit(20))).alias("content"), F.lit(2).cast("long").alias("indexed_at"))
    return store.replace_chunks(kb, chunks)


def _cache(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("url", F.lit("web").alias("source"), (F.lit(NOW) - F.col("page_id") * 997 % 900_000).alias("fetched_at"), "page_id")


CACHE_SQL = f"WITH c AS (SELECT url, 'web' AS source, {NOW} - page_id * 997 % 900000 AS fetched_at, page_id FROM pages) "


def cache_fresh(spark: SparkSession, sf: str) -> DataFrame:
    return store.fresh(_cache(spark, sf), NOW)


def cache_prune(spark: SparkSession, sf: str) -> DataFrame:
    return store.prune(_cache(spark, sf), NOW)


def cache_latest(spark: SparkSession, sf: str) -> DataFrame:
    return store.latest(_cache(spark, sf).withColumn("url", F.substring_index("url", "/", 4)), ["url", "source"], ["fetched_at", "page_id"])


def cache_backfill(spark: SparkSession, sf: str) -> DataFrame:
    rows = store.fresh(_cache(spark, sf), NOW).select(text.fetch_key(F.col("source"), F.lit("markdown"), F.col("url")).alias("key"), "page_id")
    have = _cache(spark, sf).filter(F.col("page_id") % 2 == 0).select(F.concat(F.lit("web:markdown:"), "url", F.when(F.col("page_id") % 4 == 0, "#chunk-0").otherwise("")).alias("path"))
    bare = rows.withColumn("key", text.strip_fragment(F.col("key")))
    return store.to_backfill(bare, have.withColumn("path", F.regexp_replace("path", "#top", "")))


def stale_hits(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime_ns"))
    files = d.filter(F.col("mtime_ns") % 5 != 0).withColumn("size", F.col("size") + F.when(F.col("mtime_ns") % 7 == 0, 1).otherwise(0))
    return store.stale(d.select(F.concat("path", F.lit("#chunk-1")).alias("path")), d, files)


def spill_route(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("output"), F.when(F.col("doc_id") % 2 == 0, "find").alias("intent"))
    return store.spill_route(d).select("doc_id", "bytes", "indexed")


def running_caps(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.format_string("%s/%010d", "source", "doc_id").alias("path"), F.octet_length("text").cast("long").alias("size"))
    return store.within_caps(d, 5000, 1 << 20, 1 << 20)


def url_normalise(spark: SparkSession, sf: str) -> DataFrame:
    with_user = F.regexp_replace("url", "://", "://user:pw@")
    return table(spark, sf, "pages").select("page_id", text.strip_fragment(F.col("url")).alias("bare"), text.redact_userinfo(with_user).alias("redacted"), text.fetch_key(F.lit("web"), F.lit("markdown"), F.col("url")).alias("key"))


def url_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.distinct_urls(table(spark, sf, "pages"), "page_id")


def url_valid(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id")
    low = F.lower(F.hex(p % 65536))
    url = (
        F.when(p % 16 == 8, F.concat(F.lit("http://user:p/w"), p.cast("string"), F.lit("@127.0.0.1/")))
        .when(p % 16 == 9, F.concat(F.lit("http://a@b@127.0.0."), p % 256, F.lit("/")))
        .when(p % 16 == 10, F.concat(F.lit("http://10.0.0."), p % 256, F.lit("\\@example.com/")))
        .when(p % 16 == 12, F.concat(F.lit("https://u%41:x@y@[2606:4700::"), low, F.lit("]:/x")))
        .when(p % 8 == 0, F.concat(F.lit("http://10.0."), p % 256, F.lit(".9/x")))
        .when(p % 8 == 1, F.concat(F.lit("ftp://h/"), p.cast("string")))
        .when(p % 8 == 2, F.concat(F.lit("http://[fd00::"), low, F.lit("]/")))
        .when(p % 8 == 3, F.concat(F.lit("https://u@[::ffff:10.0.0."), p % 256, F.lit("]:8443/x")))
        .when(p % 8 == 4, F.concat(F.lit("https://[2606:4700::"), low, F.lit("]:8443/x")))
        .when(p % 8 == 5, F.concat(F.lit("http://[2606::"), low, F.lit("::1]/")))
        .otherwise(F.col("url"))
    )
    return table(spark, sf, "pages").select("page_id", gates.valid_fetch_url(url).alias("valid"))


def ssrf_ipv4(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id")
    ip = F.concat_ws(".", (p * 7 % 256).cast("string"), (p * 31 % 256).cast("string"), (p % 256).cast("string"), F.lit("9"))
    return table(spark, sf, "pages").select("page_id", ip.alias("ip"), gates.is_blocked_ipv4(gates.ipv4_number(ip)).alias("blocked"))


def ssrf_any(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id")
    ip = F.concat(F.lit("2002:"), F.lpad(F.hex(p * 7 % 256), 2, "0"), F.lpad(F.hex(p % 256), 2, "0"), F.lit(":0101::1"))
    return table(spark, sf, "pages").select("page_id", ip.alias("ip"), gates.is_blocked_address(ip).alias("blocked"))


def html_sniff(spark: SparkSession, sf: str) -> DataFrame:
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<body><p>"), "html")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("note "), "html")).otherwise(F.concat(F.lit(" \n"), "html"))
    return table(spark, sf, "pages").select("page_id", gates.looks_like_html(body).alias("is_html"))


def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", ingest.html_to_markdown(F.col("html")).alias("markdown"))


def fetch_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as stored responses of several types, formats and statuses, cut at 3000 bytes."""
    p = F.col("page_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("text/plain; charset=utf-8", "application/json;v=1", ";odd", "Text/HTML", "application/xml")]), (p % 5 + 1).cast("int"))
    format_ = F.when(p % 5 == 3, "html").when(p % 7 == 6, "pdf").otherwise("")
    rows = table(spark, sf, "pages").select("page_id", "url", F.when(p % 11 == 0, 404).when(p % 11 == 1, 301).otherwise(200).alias("status"), kind.alias("content_type"), format_.alias("format"), F.col("html").alias("body"))
    return ingest.response_texts(rows, 3000)


def audit_generations(spark: SparkSession, sf: str) -> DataFrame:
    """The files that the calls of a log fill, 100,000 bytes each, by their first and last call."""
    calls = table(spark, sf, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("session_id"))
    lines = generations(calls, ["event_id"], 100_000).select("generation", F.octet_length("line").alias("n"), F.get_json_object("line", "$.event_id").cast("long").alias("event_id"))
    return lines.groupBy("generation").agg(F.count("*").alias("calls"), F.sum(F.col("n") + 1).alias("bytes"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def json_format(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", ingest.processed(F.col("props"), F.lit("application/json")).alias("json"))


def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.chunk_documents(kb_documents(spark, sf))


def chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    kb = kb_documents(spark, sf).withColumn("content", F.replace("content", F.lit("\n"), F.lit("\n\n")))
    return ingest.chunk_documents(kb).groupBy("document").agg(F.count("*").alias("chunks"), F.max(F.octet_length("content")).alias("largest"))


def secret_gate(spark: SparkSession, sf: str) -> DataFrame:
    return leaky(spark, sf).select("path", gates.has_secret(F.col("content")).alias("secret"))


def _phrase_sql(phrase: str, limit: int, kb: str = "(SELECT source || ':markdown:' || doc_id AS path, coalesce(text, '') AS content FROM documents)") -> str:
    """Phrase BM25 over words of the stems in SAME_STEM; the words of a path are none of them."""
    stands = " AND ".join(f"list_contains({SAME_STEM[w]}, words[i + {k}])" for k, w in enumerate(phrase.split()))
    return f"""
    w AS (SELECT path, regexp_extract_all(lower(content), '[\\pL\\pN\\p{{Mn}}]+') AS words, len(regexp_extract_all(path, '[a-z0-9]+')) AS more FROM {kb}),
    t AS (SELECT path, len(list_filter(range(1, len(words) + 1), lambda i: {stands})) AS tf, len(words) + more AS length FROM w),
    st AS (SELECT count(*) AS n, count(*) FILTER (WHERE tf > 0) AS hits, avg(length) AS mean FROM t),
    hit AS (SELECT path, tf, length, -(CASE WHEN ln((n - hits + 0.5) / (hits + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - hits + 0.5) / (hits + 0.5)) END)
            * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS score FROM t, st WHERE tf > 0 ORDER BY score, path LIMIT {limit})"""


_RANK = "row_number() OVER (ORDER BY score, path) AS rank"
SQL = {
    "kb_search_trigram_bm25": f"WITH {_bm25_sql(NEEDLE)} SELECT path, tf, length, round(score, 6) AS score FROM hit",
    "kb_search_prefix_scope": f"WITH {_bm25_sql(NEEDLE, 'src1')} SELECT path, tf, length, round(score, 6) AS score FROM hit",
    "kb_search_porter_bm25": f"WITH {_phrase_sql(PHRASE, 20)} SELECT path, tf, length, round(score, 6) AS score FROM hit",
    "kb_search_index": f"WITH {_phrase_sql(PHRASE, 20)} SELECT path, tf, length, round(score, 6) AS score FROM hit",
    "kb_search_index_many": " UNION ALL ".join(f"SELECT '{q}' AS query, path, tf, length, round(score, 6) AS score FROM (WITH {_phrase_sql(q, 5)} SELECT * FROM hit)" for q in (PHRASE, "the", "thing the")),
    "kb_search_substring_index": f"WITH {_bm25_sql(NEEDLE)} SELECT path, tf, length, round(score, 6) AS score FROM hit",
    "kb_search_substring_index_many": " UNION ALL ".join(f"SELECT '{q}' AS query, path, round(score, 6) AS score FROM (WITH {_bm25_sql(q, '', 5)} SELECT path, score FROM hit)" for q in (NEEDLE, SECOND, "is the on")),
    "kb_index_upkeep": f"""WITH documents_after AS (
            SELECT path, CASE WHEN doc_id % 5 = 0 THEN left(c, 600) WHEN doc_id % 5 = 1 THEN left(c, 300) ELSE c END AS content FROM ({_KB}) WHERE doc_id % 10 <> 2 AND NOT (source = 'src1' AND doc_id % 3 = 0)
            UNION ALL SELECT path || '#chunk-' || k, CASE WHEN k = 0 THEN left(c, 400) ELSE substr(c, 401, 200) END FROM ({_KB}), (VALUES (0), (1)) v(k) WHERE doc_id % 10 = 2),
        {_bm25_sql(NEEDLE, "", 30, "SELECT path, content FROM documents_after")}, part AS (SELECT * FROM hit),
        words AS (WITH {_phrase_sql(PHRASE, 30, "documents_after")} SELECT * FROM hit),
        lists AS (SELECT 'part' AS kind, path, tf, length, round(score, 6) AS score FROM part UNION ALL SELECT 'phrase', path, tf, length, round(score, 6) FROM words)
        SELECT *, false AS merged FROM lists UNION ALL SELECT *, true FROM lists""",
    "kb_search_scopes": " UNION ALL ".join(
        f"SELECT '{name}' AS scope, path, tf, length, round(score, 6) AS score FROM (WITH {_bm25_sql(NEEDLE, prefix, 10, _SCOPED)} SELECT * FROM hit)" for name, prefix in (("batch", "batch:src1:"), ("lines", "session:src2:rg:"))
    ),
    "kb_search_rrf": f"""WITH l1 AS (WITH {_bm25_sql(NEEDLE, "", 30)} SELECT path, '{NEEDLE}' AS s, {_RANK} FROM hit),
        l2 AS (WITH {_bm25_sql(SECOND, "", 30)} SELECT path, '{SECOND}' AS s, {_RANK} FROM hit)
        SELECT coalesce(l1.path, l2.path) AS path, coalesce(l1.s, l2.s) AS snippet,
               round(coalesce(1.0 / (60 + l1.rank), 0) + coalesce(1.0 / (60 + l2.rank), 0), 8) AS score
        FROM l1 FULL JOIN l2 ON l1.path = l2.path
        ORDER BY coalesce(1.0 / (60 + l1.rank), 0) + coalesce(1.0 / (60 + l2.rank), 0) DESC, 1 LIMIT 20""",
    "kb_search_fuzzy_flag": f"""WITH l1 AS (WITH {_bm25_sql(NEEDLE, "", 30)} SELECT path FROM hit), l2 AS (WITH {_bm25_sql(SECOND, "", 30)} SELECT path FROM hit),
        n AS (SELECT (SELECT count(*) FROM l1) AS words, (SELECT count(*) FROM l2) AS parts,
              least(20, (SELECT count(*) FROM (SELECT path FROM l1 UNION SELECT path FROM l2))) AS fused)
        SELECT words, parts, fused, fused < 2 AND parts > words AS corrected FROM n""",
    "kb_search_proximity": f"""WITH {_bm25_sql(NEEDLE)}, s AS (SELECT path, score, replace(content, '{NEEDLE}', '<b>{NEEDLE}</b>') AS snip FROM hit),
        r AS (SELECT path, snip, count(*) OVER () AS n, row_number() OVER (ORDER BY score, path) - 1 AS i FROM s)
        SELECT path, round(CASE WHEN n > 1 THEN n - i + ((length(snip) - length(replace(snip, '<b>', ''))) // 3) * 100.0 / length(snip) ELSE n - i END, 6) AS boosted FROM r""",
    "kb_multi_query": " UNION ALL ".join(f"SELECT '{q}' AS query, path, round(score, 6) AS score FROM (WITH {_bm25_sql(q, '', 5)} SELECT path, score FROM hit)" for q in (NEEDLE, SECOND, "is the on")),
    "kb_list": "SELECT source || ':markdown:' || doc_id AS path, strlen(coalesce(text, '')) AS bytes FROM documents",
    "kb_get": "SELECT * FROM (SELECT source || ':markdown:' || doc_id AS path, coalesce(text, '') AS content FROM documents) WHERE path = 'src7:markdown:7'",
    "kb_stats": "SELECT count(*) AS documents, sum(strlen(coalesce(text, '')))::BIGINT AS bytes FROM documents",
    "kb_health_parity": "SELECT count(*) AS documents, count(*) FILTER (WHERE strlen(text) > 100) AS indexed, count(*) FILTER (WHERE NOT coalesce(strlen(text) > 100, false)) AS differ FROM documents",
    "first_index_token": "SELECT source || ':markdown:' || doc_id AS path, left(regexp_extract(coalesce(text, ''), '[A-Za-z0-9]{3,}'), 8) AS token FROM documents",
    "purge_session": SESSIONS_SQL + "SELECT * FROM s WHERE NOT (path = 'session:src1' OR starts_with(path, 'session:src1:'))",
    "purge_prefix": SESSIONS_SQL + "SELECT * FROM s WHERE NOT starts_with(path, 'session:src1')",
    "purge_dry_run": SESSIONS_SQL + ", g AS (SELECT path = 'session:src1' OR starts_with(path, 'session:src1:') AS gone FROM s) SELECT count(*) FILTER (WHERE gone) AS removed, count(*) FILTER (WHERE NOT gone) AS kept FROM g",
    "purge_exact_chunks": CHUNKS_SQL + "SELECT * FROM c WHERE NOT (path = 'src7:x:2' OR starts_with(path, 'src7:x:2#chunk-'))",
    "documents_of_chunks": CHUNKS_SQL + "SELECT split_part(path, '#chunk-', 1) AS document, count(*) AS chunks FROM c GROUP BY 1",
    "purge_legacy": SESSIONS_SQL + ", u AS (SELECT 'web:' || url AS path, page_id FROM pages UNION ALL SELECT path, doc_id FROM s) SELECT path, page_id FROM u WHERE NOT regexp_matches(lower(path), '^web:https?://')",
    "upsert_latest": """SELECT path, regexp_replace(CASE WHEN strlen(content) > 1000 THEN left(content, 50) ELSE content END, '^\\[def\\] ', ' [def] ') AS content,
        CASE WHEN strlen(content) > 1000 THEN 2 ELSE 1 END::BIGINT AS indexed_at FROM (SELECT source || ':markdown:' || doc_id AS path, coalesce(text, '') AS content FROM documents)""",
    "replace_chunks": """WITH kb AS (SELECT source || ':markdown:' || doc_id AS path, coalesce(text, '') AS content FROM documents),
        c AS (SELECT path AS document, unnest(range(0, least(strlen(content) // 2000, 2) + 1)) AS k, left(content, 20) AS head, least(strlen(content) // 2000, 2) + 1 AS n FROM kb WHERE starts_with(path, 'src3:'))
        SELECT path, content, 1::BIGINT AS indexed_at FROM kb WHERE NOT starts_with(path, 'src3:')
        UNION ALL SELECT document || CASE WHEN n = 1 THEN '' ELSE '#chunk-' || k END, k || ':' || head, 2 FROM c""",
    "cache_fresh": CACHE_SQL + f"SELECT * FROM c WHERE {NOW} - fetched_at < 86400",
    "cache_prune": CACHE_SQL + f"SELECT * FROM c WHERE fetched_at >= {NOW} - 7 * 86400",
    "cache_latest": CACHE_SQL + ", k AS (SELECT regexp_extract(url, '^[^/]*//[^/]*/[^/]*') AS url, source, fetched_at, page_id FROM c) SELECT url, source, max(struct_pack(f := fetched_at, p := page_id)).f AS fetched_at, max(struct_pack(f := fetched_at, p := page_id)).p AS page_id FROM k GROUP BY url, source",
    "cache_backfill": CACHE_SQL + f""", k AS (SELECT 'web:markdown:' || split_part(url, '#', 1) AS key, page_id FROM c WHERE {NOW} - fetched_at < 86400)
        SELECT * FROM k WHERE key NOT IN (SELECT 'web:markdown:' || split_part(url, '#', 1) FROM c WHERE page_id % 2 = 0)""",
    "stale_hits": "SELECT source || ':' || doc_id || '#chunk-1' AS path, doc_id % 5 = 0 OR doc_id % 7 = 0 AS stale FROM documents",
    "spill_route": "SELECT doc_id, strlen(coalesce(text, '')) AS bytes, strlen(coalesce(text, '')) > 102400 OR (doc_id % 2 = 0 AND strlen(coalesce(text, '')) > 5120) AS indexed FROM documents",
    "running_caps": """WITH f AS (SELECT source || '/' || lpad(doc_id::VARCHAR, 10, '0') AS path, strlen(text) AS size FROM documents WHERE strlen(text) <= 1048576),
        r AS (SELECT *, count(*) OVER w AS n, sum(size) OVER w AS b FROM f WINDOW w AS (ORDER BY path ROWS UNBOUNDED PRECEDING)) SELECT path, size FROM r WHERE n <= 5000 AND b <= 1048576""",
    "url_normalise": "SELECT page_id, split_part(url, '#', 1) AS bare, url AS redacted, 'web:markdown:' || url AS key FROM pages",
    "url_dedupe": "SELECT split_part(url, '#', 1) AS url, min(page_id) AS pos FROM pages GROUP BY 1",
    "url_valid": "SELECT page_id, page_id % 8 = 4 OR (page_id % 8 >= 6 AND regexp_matches(url, '^https?://[^/?#]')) AS valid FROM pages",
    "ssrf_ipv4": """WITH p AS (SELECT page_id, page_id * 7 % 256 AS a, page_id * 31 % 256 AS b, page_id % 256 AS c FROM pages)
        SELECT page_id, a || '.' || b || '.' || c || '.9' AS ip, a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254)
        OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 198 AND b BETWEEN 18 AND 19) AS blocked FROM p""",
    "html_sniff": """WITH h AS (SELECT page_id, lower(CASE page_id % 3 WHEN 0 THEN '<body><p>' || html WHEN 1 THEN 'note ' || html ELSE ltrim(html, E' \\t\\n\\r') END) AS b FROM pages),
        t AS (SELECT page_id, b, list_sum(list_transform(['<html','</html','<head','</head','<body','</body','<meta','<link','<title','<script','<div','<span'], lambda x: contains(left(b, 512), x)::INT)) AS n FROM h)
        SELECT page_id, starts_with(b, '<!doctype html') OR starts_with(b, '<html') OR ((starts_with(b, '<head') OR starts_with(b, '<body')) AND n >= 2) AS is_html FROM t""",
    "secret_gate": f"WITH {LEAKY_SQL} SELECT path, {secret_sql('content')} AS secret FROM leaky",
    "ssrf_any": """WITH p AS (SELECT page_id, page_id * 7 % 256 AS a, page_id % 256 AS b FROM pages)
        SELECT page_id, '2002:' || printf('%02X', a) || printf('%02X', b) || ':0101::1' AS ip, a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254)
        OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 198 AND b BETWEEN 18 AND 19) AS blocked FROM p""",
    "fetch_responses": f"""WITH r AS (SELECT page_id, url, CASE WHEN page_id % 11 = 0 THEN 404 WHEN page_id % 11 = 1 THEN 301 ELSE 200 END AS status, ['text/plain', 'application/json', ';odd', 'Text/HTML', 'application/xml'][page_id % 5 + 1] AS content_type,
            CASE WHEN page_id % 5 = 3 THEN 'html' WHEN page_id % 7 = 6 THEN 'pdf' ELSE '' END AS format, coalesce(html, '') AS body FROM pages),
        e AS (SELECT *, CASE WHEN status <> 200 THEN 'HTTP ' || status WHEN format = 'pdf' THEN 'unknown format: pdf' WHEN format = '' AND content_type = 'application/json' AND strlen(body) > 3000 THEN 'JSON was cut at the size limit' END AS error FROM r)
        SELECT page_id, url, content_type, status = 200 AND strlen(body) > 3000 AS truncated, error, CASE WHEN error IS NULL THEN {head_sql('body', 3000)} END AS content FROM e""",
    "audit_generations": """WITH l AS (SELECT event_id, strlen('{"event_id":' || event_id || ',"event_type":"' || event_type || '","session_id":"' || user_id || '"}') + 1 AS n FROM events),
        g AS (SELECT event_id, n, (coalesce(sum(n) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 100000)::BIGINT AS generation FROM l)
        SELECT generation, count(*) AS calls, sum(n)::BIGINT AS bytes, min(event_id) AS first, max(event_id) AS last FROM g GROUP BY generation""",
    "json_format": """SELECT event_id, CASE WHEN regexp_matches(props, '^\\{"k": *-?[0-9]+\\}$') THEN '{' || chr(10) || '  "k": ' || regexp_extract(props, '-?[0-9]+') || chr(10) || '}' ELSE props END AS json FROM events""",
    "chunk_documents": f"""WITH RECURSIVE t AS (SELECT source || ':markdown:' || doc_id AS document, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t, coalesce(text, '') AS whole FROM documents),
        r AS (SELECT document, 0 AS chunk_no, CASE WHEN t = '' THEN whole ELSE {head_sql('t', 4000)} END AS content, CASE WHEN t = '' THEN '' ELSE substr(t, length({head_sql('t', 4000)}) + 1) END AS rest FROM t
        UNION ALL SELECT document, chunk_no + 1, {head_sql('rest', 4000)}, substr(rest, length({head_sql('rest', 4000)}) + 1) FROM r WHERE rest <> '')
        SELECT document, chunk_no, content FROM r""",
    "chunk_counts": f"""WITH RECURSIVE l AS (SELECT source || ':markdown:' || doc_id AS document, strlen(replace(coalesce(text, ''), chr(10), chr(10) || chr(10))) AS whole,
            list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS parts FROM documents),
        p AS (SELECT document, i, parts[i] AS p, strlen(parts[i]) AS n FROM (SELECT document, parts, unnest(range(1, len(parts) + 1)) AS i FROM l)),
        c AS (SELECT document, i, {head_sql('p', 4000)} AS head, substr(p, length({head_sql('p', 4000)}) + 1) AS rest FROM p WHERE n > 4000
            UNION ALL SELECT document, i, {head_sql('rest', 4000)}, substr(rest, length({head_sql('rest', 4000)}) + 1) FROM c WHERE rest <> ''),
        b AS (SELECT document, i, count(*) AS pieces, max(strlen(head)) AS most FROM c GROUP BY document, i),
        r AS (SELECT document, 0 AS k, 0::BIGINT AS now, 0::BIGINT AS chunks, 0::BIGINT AS largest FROM l
            UNION ALL SELECT r.document, r.k + 1, CASE WHEN p.n > 4000 THEN 0 WHEN r.now > 0 AND r.now + p.n + 2 <= 4000 THEN r.now + p.n + 2 ELSE p.n END,
                r.chunks + CASE WHEN r.now > 0 AND (p.n > 4000 OR r.now + p.n + 2 > 4000) THEN 1 ELSE 0 END + CASE WHEN p.n > 4000 THEN b.pieces ELSE 0 END,
                greatest(r.largest, r.now, coalesce(b.most, 0)) FROM r JOIN p ON p.document = r.document AND p.i = r.k + 1 LEFT JOIN b ON b.document = p.document AND b.i = p.i),
        e AS (SELECT document, max_by(now, k) AS now, max(chunks) AS chunks, max(largest) AS largest FROM r GROUP BY document)
        SELECT e.document, greatest(1, chunks + CASE WHEN now > 0 THEN 1 ELSE 0 END) AS chunks, CASE WHEN chunks = 0 AND now = 0 THEN whole ELSE greatest(largest, now) END::INT AS largest FROM e JOIN l ON l.document = e.document""",
}
QUERIES = [
    kb_search_trigram_bm25, kb_search_prefix_scope, kb_search_porter_bm25, kb_search_rrf, kb_search_fuzzy_flag, kb_search_proximity, kb_search_proximity_snippet, kb_search_pipeline,
    kb_search_index, kb_search_index_many, kb_search_index_pipeline, kb_search_substring_index, kb_search_substring_index_many, kb_index_upkeep, kb_search_scopes,
    kb_multi_query, kb_list, kb_get, kb_stats, kb_health_parity, first_index_token, purge_session, purge_prefix, purge_dry_run, purge_exact_chunks,
    documents_of_chunks, purge_legacy, upsert_latest, replace_chunks, cache_fresh, cache_prune, cache_latest, cache_backfill, stale_hits, spill_route,
    running_caps, url_normalise, url_dedupe, url_valid, ssrf_ipv4, ssrf_any, html_sniff, html_to_text, fetch_responses, audit_generations, json_format, chunk_documents, chunk_counts, secret_gate,
]
