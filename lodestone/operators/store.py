"""The document table: upserts, chunk sets, deletes by key shape, the fetch cache, statistics.

Every function maps DataFrames to DataFrames; a caller overwrites its table with the result. Deletes and
counts by prefix are range filters that reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gates import has_secret
from ..functions.text import DEF_MARK

CHUNK = "#chunk-"
#: Outputs above these sizes go to the store instead of the reply.
LARGE_BYTES, INTENT_BYTES = 102_400, 5_120
PURGE_PHRASE = "purge project "


def base_path(path: Column) -> Column:
    """The document of a chunk key."""
    return F.substring_index(path, CHUNK, 1)


def under_session(path: Column, session: str) -> Column:
    return (path == f"session:{session}") | path.startswith(f"session:{session}:")


def under_prefix(path: Column, prefix: str) -> Column:
    """Literal prefix; the empty one holds everything."""
    return path.startswith(prefix) if prefix else F.lit(True)


def document_or_chunk(path: Column, document: str) -> Column:
    return (path == document) | path.startswith(document + CHUNK)


def purge(table: DataFrame, gone: Column) -> DataFrame:
    return table.filter(~gone)


def purge_counts(table: DataFrame, gone: Column) -> DataFrame:
    """What a purge would remove and leave (a dry run)."""
    return table.agg(F.count_if(gone).alias("removed"), F.count_if(~gone).alias("kept"))


def purge_project(table: DataFrame, name: str, phrase: str, confirm: bool) -> DataFrame:
    """Empties the table; needs ``confirm`` and the exact phrase for this name."""
    if not confirm or phrase != PURGE_PHRASE + name:
        raise ValueError(f"purging needs confirm and the phrase '{PURGE_PHRASE}{name}'")
    return table.limit(0)


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; a map-side aggregate, no sort."""
    rest = [c for c in rows.columns if c not in key]
    pick = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*key).agg(pick.alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def neutralise(content: Column) -> Column:
    return F.regexp_replace(content, r"(?m)^(?=\Q" + DEF_MARK + r"\E)", " ")


def upsert(table: DataFrame, new: DataFrame) -> DataFrame:
    """New versions replace old ones by path; content with a secret is refused, literal marks are neutralised."""
    clean = new.filter(~has_secret(F.col("content"))).withColumn("content", neutralise(F.col("content")))
    return latest(table.unionByName(clean), ["path"], ["indexed_at", "content"])


def refused(new: DataFrame) -> DataFrame:
    return new.filter(has_secret(F.col("content"))).select("path")


def replace_chunks(table: DataFrame, chunks: DataFrame) -> DataFrame:
    """Replaces documents by their new chunks (document, chunk_no, content, indexed_at).

    A set is refused as a whole if any chunk holds a secret; then the old rows stay. One chunk goes by the bare path.
    """
    marks = chunks.groupBy("document").agg(F.bool_or(has_secret(F.col("content"))).alias("secret"), F.count("*").alias("n"))
    fine = marks.filter(~F.col("secret")).select("document", "n")
    path = F.when(F.col("n") == 1, F.col("document")).otherwise(F.concat("document", F.lit(CHUNK), F.col("chunk_no").cast("string")))
    new = chunks.join(fine, "document").select(path.alias("path"), "content", "indexed_at")
    old = table.withColumn("_d", base_path(F.col("path"))).join(fine.select(F.col("document").alias("_d")), "_d", "left_anti").drop("_d")
    return old.unionByName(new)


def delete_legacy_fetches(table: DataFrame, source: str) -> DataFrame:
    return table.filter(~F.lower("path").startswith(f"{source}:http://".lower()) & ~F.lower("path").startswith(f"{source}:https://".lower()))


def fresh(cache: DataFrame, now: int, ttl_seconds: int = 86_400) -> DataFrame:
    """Cache rows younger than the limit; a limit of 0 gives none."""
    return cache.filter(F.lit(now) - F.col("fetched_at") < ttl_seconds)


def prune(cache: DataFrame, now: int, days: int = 7) -> DataFrame:
    return cache.filter(F.col("fetched_at") >= now - days * 86_400)


def to_backfill(fresh_rows: DataFrame, table: DataFrame) -> DataFrame:
    """Fresh rows (key, ...) without a document under their key."""
    have = table.select(base_path(F.col("path")).alias("key")).distinct()
    return fresh_rows.join(have, "key", "left_anti")


def valid_ttl_ms(ttl: Column) -> Column:
    return ttl.between(0, 30 * 86_400_000)


def stale(hits: DataFrame, documents: DataFrame, files: DataFrame) -> DataFrame:
    """Hits whose document was indexed from a file that has changed: left joins on the document's path."""
    d = documents.select(F.col("path").alias("_p"), F.col("mtime_ns").alias("_m"), F.col("size").alias("_s"))
    f = files.select(F.col("path").alias("_p"), F.col("mtime_ns").alias("_fm"), F.col("size").alias("_fs"))
    joined = hits.withColumn("_p", base_path(F.col("path"))).join(d, "_p", "left").join(f, "_p", "left")
    changed = F.col("_fm").isNull() | (F.col("_m") != F.col("_fm")) | (F.col("_s") != F.col("_fs"))
    return joined.withColumn("stale", F.col("_m").isNotNull() & changed).drop("_p", "_m", "_s", "_fm", "_fs")


def health(table: DataFrame, index: DataFrame) -> DataFrame:
    """Whether the table and an index (path, ...) hold the same keys."""
    a, b = table.select("path").distinct(), index.select("path").distinct()
    n = a.withColumn("in_table", F.lit(1)).join(b.withColumn("in_index", F.lit(1)), "path", "full_outer")
    return n.agg(F.count("in_table").alias("documents"), F.count("in_index").alias("indexed"), F.count_if(F.col("in_table").isNull() | F.col("in_index").isNull()).alias("differ"))


def spill_route(outputs: DataFrame, text_col: str = "output", intent_col: str = "intent") -> DataFrame:
    """Marks outputs that go to the store: over the large size, or over the small one with an intent."""
    size = F.octet_length(text_col)
    wanted = F.coalesce(F.col(intent_col), F.lit("")) != ""
    return outputs.withColumn("bytes", size.cast("long")).withColumn("indexed", (size > LARGE_BYTES) | (wanted & (size > INTENT_BYTES)))


def keep_newest(rows: DataFrame, order: list[Column], n: int = 64, by: list[str] | None = None) -> DataFrame:
    """The first n rows of each key in the given order; without a key the first n of all, by a bounded top-n."""
    if not by:
        return rows.orderBy(*order).limit(n)
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def within_caps(files: DataFrame, max_files: int = 5000, max_file_bytes: int = 1 << 20, max_total: int = 100 << 20) -> DataFrame:
    """Files in path order until the count or the bytes run out.

    The count is a bounded top-n, so the running sum is over ``max_files`` rows at most.
    """
    w = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fit = files.filter(F.col("size") <= max_file_bytes).orderBy("path").limit(max_files)
    return fit.withColumn("_b", F.sum("size").over(w)).filter(F.col("_b") <= max_total).drop("_b")
