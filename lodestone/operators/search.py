"""Full-text search: stemmed phrases and substrings by BM25, rank fusion, fallback, proximity.

Statistics are those of the whole table, also when a path prefix narrows the hits. Ranks are total: ties go by path.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import raw_tokens, tokens
from ..sources.shared import delete_folder, new_folder

#: The best of a list: of so many rows path, content and score.
Fetch = Callable[[int], DataFrame]
K1, B = 1.2, 0.75
RRF_SHIFT = 60


def over_fetch(limit: int) -> int:
    return max(30, 3 * limit)


def occurrences(text: Column, needle: str) -> Column:
    """How often a needle occurs, overlaps counted."""
    if needle not in (needle + needle)[1:-1] and not any(needle.startswith(needle[k:]) for k in range(1, len(needle))):
        return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")
    return F.regexp_count(text, F.lit(f"(?=\\Q{needle}\\E)")).cast("long")


def bm25(tf: Column, length: Column, n_docs: Column | int, n_hits: Column | int, mean_length: Column | float) -> Column:
    """Lower is better; a term in over half of the rows counts next to nothing."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    n_docs, n_hits, mean_length = map(as_col, (n_docs, n_hits, mean_length))
    idf = F.ln((n_docs - n_hits + 0.5) / (n_hits + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    return -idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / mean_length))


def _ranked(scored: DataFrame, limit: int, prefix: str | None) -> DataFrame:
    """Adds BM25 to rows (path, content, tf, length) and keeps the best."""
    stats = scored.agg(F.count("*").alias("n"), F.count_if(F.col("tf") > 0).alias("hits"), F.avg("length").alias("mean")).first()
    hits = scored.filter("tf > 0")
    if prefix:
        hits = hits.filter(F.col("path").startswith(prefix))
    score = bm25(F.col("tf"), F.col("length"), stats["n"], stats["hits"], float(stats["mean"] or 1.0) or 1.0)
    return hits.select("path", "content", "tf", "length", score.alias("score")).orderBy("score", "path").limit(limit)


def _ranked_once(docs: DataFrame, scored: DataFrame, limit: int, prefix: str | None) -> DataFrame:
    """As ``_ranked``, for rows (path, tf, length) that cost too much to be made twice: statistics are observed while the hits are written.

    The ``limit`` best come to the driver; their contents are joined by path, which is taken to be unique.
    """
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "hits")
    seen = Observation()
    counted = scored.observe(seen, F.count("*").alias("n"), F.count_if(F.col("tf") > 0).alias("hits"), F.sum("length").alias("total"))
    counted.filter("tf > 0").write.parquet(folder)
    n, count, total = (seen.get[c] or 0 for c in ("n", "hits", "total"))
    hits = spark.read.schema("path string, tf long, length long").parquet(folder)
    if prefix:
        hits = hits.filter(F.col("path").startswith(prefix))
    score = bm25(F.col("tf"), F.col("length"), n, count, (total / n if n else 1.0) or 1.0)
    best = hits.select("path", "tf", "length", score.alias("score")).orderBy("score", "path").limit(limit).collect()
    delete_folder(spark, folder)
    small = spark.createDataFrame(best, "path string, tf long, length long, score double")
    texts = docs.select("path", "content").filter(F.col("path").isin([r["path"] for r in best]))
    return small.join(texts, "path").select("path", "content", "tf", "length", "score").orderBy("score", "path")


def search_trigram(docs: DataFrame, query: str, limit: int = 20, prefix: str | None = None) -> DataFrame:
    """Case-folded substring search over path and content: path, content, tf, length, score.

    Fewer than three characters find nothing. Runs in the JVM; content and path are read once for the statistics and once for the hits.
    """
    q = query.lower()
    if len(q) < 3:
        return docs.select("path", "content", F.lit(0).cast("long").alias("tf"), F.lit(0).cast("long").alias("length"), F.lit(0.0).alias("score")).filter("false")
    columns = [F.lower("content"), F.lower("path")]
    tf = reduce(lambda a, b: a + b, [occurrences(c, q) for c in columns])
    length = reduce(lambda a, b: a + b, [F.greatest(F.lit(0), F.length(c) - 2) for c in columns]).cast("long")
    return _ranked(docs.select("path", "content", tf.alias("tf"), length.alias("length")), limit, prefix)


def phrase_count(words: list[str], phrase: list[str]) -> int:
    n, first = len(phrase), phrase[0]
    return sum(1 for k in range(len(words) - n + 1) if words[k] == first and words[k : k + n] == phrase)


def search_porter(docs: DataFrame, query: str, limit: int = 20, prefix: str | None = None) -> DataFrame:
    """Phrase search on stemmed words: the words must be adjacent, in order, in one column."""
    phrase = tokens(query)

    def count(content: str | None, path: str | None) -> tuple[int, int]:
        pair = tokens(content or ""), tokens(path or "")
        return sum(phrase_count(w, phrase) for w in pair) if phrase else 0, len(pair[0]) + len(pair[1])

    # by rows: whole texts in Arrow batches would lie in a worker ten thousand at a time
    counted = docs.select("path", F.udf(count, "tf long, length long", useArrow=False)("content", "path").alias("_count"))
    return _ranked_once(docs, counted.select("path", "_count.tf", "_count.length"), limit, prefix)


def literal_phrase(query: str) -> str:
    """The query as one quoted phrase of a match expression."""
    return '"' + query.replace('"', '""') + '"'


def literal_terms(query: str) -> str:
    """The query's words, each quoted unless it is a number."""
    return " ".join(w if re.fullmatch(r"[0-9]+(?:\.[0-9]+)?", w) else literal_phrase(w) for w in query.split())


def best_window(words: list[tuple[str, int, int]], spans: list[tuple[int, int]], size: int) -> int:
    """The first word of the first window of ``size`` words with most whole spans, of all windows that begin at a span or end the text."""
    starts, ends = [w[1] for w in words], [w[2] for w in words]
    first = [bisect.bisect_right(starts, s) - 1 for s, _ in spans]
    last = [bisect.bisect_left(ends, e) for _, e in spans]
    best, most, left, right = 0, 0, 0, 0
    for k in first:  # both edges only move on
        k = max(0, min(k, len(words) - size))
        while left < len(spans) and first[left] < k:
            left += 1
        while right < len(spans) and last[right] < k + size:
            right += 1
        if right - left > most:
            best, most = k, right - left
    return best


def snippet(query: str, stemmed: bool, size: int = 256):
    """Up to ``size`` words around the most hits, hits in <b></b>, cut ends as dots."""
    phrase = tokens(query)
    needle = query.lower()

    def one(text: str | None) -> str:
        text = text or ""
        words = raw_tokens(text)
        if stemmed:
            stems, n = tokens(text), len(phrase)
            spans = [(words[k][1], words[k + n - 1][2]) for k in range(len(stems) - n + 1) if n and stems[k : k + n] == phrase]
        else:
            low = text.lower()
            spans, at = [], low.find(needle) if len(low) == len(text) and needle else -1
            while at >= 0:
                spans.append((at, at + len(needle)))
                at = low.find(needle, at + 1)
        lo, hi = 0, len(text)
        if len(words) > size:
            best = best_window(words, spans, size)
            lo, hi = words[best][1], words[best + size - 1][2]
        merged: list[list[int]] = []
        for s, e in spans:
            if s < lo or e > hi:
                continue
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        out, at = [], lo
        for s, e in merged:
            out += [text[at:s], "<b>", text[s:e], "</b>"]
            at = e
        out.append(text[at:hi])
        return ("..." if lo else "") + "".join(out) + ("..." if hi < len(text) else "")

    return F.pandas_udf(lambda s: s.map(one), "string")


def with_rank(hits: DataFrame) -> DataFrame:
    """1-based positions by score, then path; the lists are at most a few thousand rows long."""
    return hits.withColumn("rank", F.expr("row_number() OVER (ORDER BY score, path)"))


def rrf_merge(first: DataFrame, second: DataFrame, limit: int = 20) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (path, snippet, rank): path, snippet, score."""
    a = first.select("path", F.col("snippet").alias("s1"), F.col("rank").alias("r1"))
    b = second.select("path", F.col("snippet").alias("s2"), F.col("rank").alias("r2"))
    part = lambda r: F.coalesce(1.0 / (RRF_SHIFT + F.col(r)), F.lit(0.0))
    both = a.join(b, "path", "full_outer").select("path", F.coalesce("s1", "s2").alias("snippet"), (part("r1") + part("r2")).alias("score"))
    return both.orderBy(F.col("score").desc(), "path").limit(limit)


def proximity_density(text: Column) -> Column:
    """Hit marks per hundred characters."""
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit("<b>")) * 100.0 / F.length(text)).otherwise(0.0)


def proximity_rerank(hits: DataFrame, query: str, order: list[Column]) -> DataFrame:
    """Re-sorts by (n - i) plus density, for two results and two query words at least."""
    ranked = hits.withColumn("_i", F.row_number().over(_window(order)) - 1).withColumn("_n", F.count("*").over(_all()))
    boost = (F.col("_n") - F.col("_i")) + proximity_density(F.col("snippet"))
    key = F.when((F.col("_n") > 1) & F.lit(len(query.split()) > 1), boost).otherwise(F.col("_n") - F.col("_i"))
    return ranked.withColumn("boosted", key.cast("double")).orderBy(F.col("boosted").desc(), "_i").drop("_i", "_n")


def _window(order: list[Column]):
    from pyspark.sql import Window

    return Window.orderBy(*order)


def _all():
    from pyspark.sql import Window

    return Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


META = "flood_status string, corrected boolean, total_hits long, failures array<struct<list:string,error:string>>, error string"
RESULT = "path string, snippet string, score double"
BLOCKED = "search blocked: too many calls in a short time"
LISTS = ("words", "parts")


def first_error(first: str | None, second: str | None, n_first: int, n_second: int) -> str | None:
    """The error of a search over two lists: both failed, or one failed and the other is empty; else none."""
    if first and second:
        return f"{first}; {second}"
    if (first and not n_second) or (second and not n_first):
        return first or second
    return None


def line_search_prefix(session: str | None) -> str:
    """The key prefix of a session's line searches."""
    return f"session:{session}:rg:" if session else "rg:"


def batch_prefix(run: str | None = None) -> str:
    """The key prefix of one batch run, or of all."""
    return f"batch:{run}:" if run else "batch:"


def plain_lists(docs: DataFrame, query: str, prefix: str | None) -> tuple[Fetch, Fetch]:
    """The stemmed and the substring list from the texts themselves."""
    return (lambda n: search_porter(docs, query, n, prefix)), (lambda n: search_trigram(docs, query, n, prefix))


def indexed_lists(spark: SparkSession, folder: str, query: str, prefix: str | None) -> tuple[Fetch, Fetch]:
    """Both lists from an index; only the contents of their hits are read."""
    from . import index

    def with_content(best: DataFrame) -> DataFrame:
        scores = {r["path"]: r["score"] for r in best.select("path", "score").collect()}  # at most the over-fetch
        rows = spark.createDataFrame(list(scores.items()), "path string, score double")
        return index.contents_of(spark, folder, list(scores)).join(F.broadcast(rows), "path")

    return (lambda n: with_content(index.search_index(spark, folder, query, n, prefix))), (lambda n: with_content(index.search_substring(spark, folder, query, n, prefix)))


def guarded_search(spark: SparkSession, query: str, lists: tuple[Fetch, Fetch], limit: int = 20, status: str = "ok") -> tuple[DataFrame, DataFrame]:
    """The whole pipeline: guard, both lists, fusion, fallback to substrings, proximity. Gives the results (path, snippet, score) and one row about them.

    ``status`` is the limiter's answer: a blocked search runs nothing, a throttled one halves its limit, down to one. The lists run side by side,
    each fetched once and bounded by the over-fetch; what follows is a small literal table. A list that fails is a row of
    ``failures``; the search has an error only if both fail, or one fails and the other finds nothing. Without a limit there are no results.
    """
    limit = max(0, limit)

    def answer(rows: list[tuple], corrected: bool, failures: list[tuple], error: str | None) -> tuple[DataFrame, DataFrame]:
        meta = spark.createDataFrame([(status, corrected, len(rows), failures, error)], META)
        return spark.createDataFrame(rows, RESULT), meta

    if status == "blocked":
        return answer([], False, [], BLOCKED)
    limit = max(1, limit // 2) if status == "throttled" and limit > 1 else limit
    fetch = over_fetch(limit)

    def ranked(which: Fetch, stemmed: bool) -> tuple[list[tuple], str | None]:
        try:
            found = with_rank(which(fetch).select("path", "score", snippet(query, stemmed)(F.col("content")).alias("snippet")))
            return [(r["path"], r["snippet"], r["rank"]) for r in found.collect()], None
        except (PySparkException, Py4JError) as e:
            return [], str(e).split("\n")[0]

    with ThreadPoolExecutor(2) as pool:
        (words, bad_words), (parts, bad_parts) = pool.map(inheritable_thread_target(spark)(ranked), lists, (True, False))
    failures = [(name, e) for name, e in zip(LISTS, (bad_words, bad_parts), strict=True) if e]
    if error := first_error(bad_words, bad_parts, len(words), len(parts)):
        return answer([], False, failures, error)
    a, b = (spark.createDataFrame(x, "path string, snippet string, rank int") for x in (words, parts))
    fused = rrf_merge(a, b, limit)
    corrected = len(parts) > len(words) and min(limit, len({r[0] for r in words + parts})) < 2
    if corrected:
        fused = b.orderBy("rank").limit(limit).select("path", "snippet", (1.0 / (RRF_SHIFT + F.col("rank"))).alias("score"))
    out = proximity_rerank(fused, query, [F.col("score").desc(), F.col("path")]).select("path", "snippet", "score")
    return answer([tuple(r) for r in out.collect()], corrected, failures, None)


def search(docs: DataFrame, query: str, limit: int = 20, prefix: str | None = None, status: str = "ok", index: str | None = None) -> DataFrame:
    """The results of the pipeline with the flag ``corrected``, best first; an error of the search is raised. ``index`` is the folder of an index of the documents."""
    spark = docs.sparkSession
    lists = indexed_lists(spark, index, query, prefix) if index else plain_lists(docs, query, prefix)
    found, meta = guarded_search(spark, query, lists, limit, status)
    about = meta.first()
    if about["error"]:
        raise RuntimeError(about["error"])
    return found.withColumn("corrected", F.lit(about["corrected"]))


def search_lines(docs: DataFrame, query: str, session: str | None, limit: int = 20, status: str = "ok", index: str | None = None) -> DataFrame:
    """A search within what a session's line searches have stored."""
    return search(docs, query, limit, line_search_prefix(session), status, index)


def search_batch(docs: DataFrame, query: str, run: str | None = None, limit: int = 5, index: str | None = None) -> DataFrame:
    """A search within the outputs of one batch run, or of all; the limiter does not count these."""
    return search(docs, query, limit, batch_prefix(run), "ok", index)


def search_many(docs: DataFrame, queries: DataFrame, query_col: str = "query", limit: int = 5) -> DataFrame:
    """Up to 20 stated queries at once, as substrings: query, path, score. One pass over the documents per query."""
    found = queries.select(query_col).distinct().orderBy(query_col).limit(21).collect()
    if len(found) > 20:
        raise ValueError("at most 20 queries")
    lists = [search_trigram(docs, r[0], limit).select(F.lit(r[0]).alias("query"), "path", "score") for r in found]
    return reduce(DataFrame.unionByName, lists)
