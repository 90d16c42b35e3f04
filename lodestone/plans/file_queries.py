"""Registered queries: file intake and line formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import files, grep
from ..sources.tables import kb_documents, table
from .line_queries import HIT_SQL, PATHS_SQL, PATTERN, _paths
from .search_queries import LEAKY_SQL, leaky, secret_sql


def files_indexable(spark: SparkSession, sf: str) -> DataFrame:
    return files.indexable(_paths(spark, sf).withColumn("size", (F.length("path") * 40_000).cast("long")))


def skip_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return files.skip_reasons(_paths(spark, sf).withColumn("size", (F.length("path") * 40_000).cast("long")))


def index_files(spark: SparkSession, sf: str) -> DataFrame:
    d = leaky(spark, sf).select("path", F.col("content").cast("binary").alias("content"))
    return files.index_files(d.withColumn("size", F.octet_length("content").cast("long")), 1000).select("path", "size", "indexed_at")


def hard_links(spark: SparkSession, sf: str) -> DataFrame:
    p = _paths(spark, sf)
    rows = p.select("path", F.lit(1).alias("dev"), (F.length("path") % 20).alias("ino"), F.when(F.length("path") % 2 == 0, 2).otherwise(1).alias("nlink"))
    return files.not_linked_to_secrets(rows).select("path", "ino")


def match_lines(spark: SparkSession, sf: str) -> DataFrame:
    hits = grep.grep(kb_documents(spark, sf), PATTERN)
    line = F.concat(F.replace("path", F.lit(":markdown:"), F.lit("/")), F.lit(":"), F.col("line_no").cast("string"), F.lit(":"), "content")
    parts = files.parse_match_line(line)
    return hits.select(*[v.alias(k) for k, v in parts.items()])


def render_matches(spark: SparkSession, sf: str) -> DataFrame:
    return files.render_matches(grep.grep(kb_documents(spark, sf), PATTERN))


def control_bytes(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, F.lit("\x07")).otherwise(F.lit("\t")))
    return table(spark, sf, "documents").select("doc_id", files.has_control_bytes(text).alias("control"))


_SECRET = r"regexp_matches(path, '(^|/)(\.env|prod\.pem\.bak|id_rsa|auth\.json\.1\.old)$') OR regexp_matches(path, '(^|/)\.ssh/') OR (regexp_matches(path, '/config\.json$') AND starts_with(path, '.docker/'))"
SQL = {
    "files_indexable": rf"WITH {PATHS_SQL} SELECT path, length(path) * 40000 AS size FROM p WHERE NOT starts_with(path, 'node_modules/') AND NOT regexp_matches(lower(path), '\.png$') AND NOT ({_SECRET}) AND length(path) * 40000 <= 1048576",
    "index_files": f"""WITH {LEAKY_SQL}, f AS (SELECT path, strlen(content) AS size, content FROM leaky),
        r AS (SELECT *, count(*) OVER w AS n, sum(size) OVER w AS b FROM f WHERE size <= 1048576 WINDOW w AS (ORDER BY path ROWS UNBOUNDED PRECEDING))
        SELECT path, size, 1000::BIGINT AS indexed_at FROM r WHERE n <= 5000 AND b <= 104857600 AND NOT {secret_sql('content')}""",
    "skip_reasons": rf"""WITH {PATHS_SQL} SELECT path, CASE WHEN starts_with(path, 'node_modules/') THEN 'skipped directory' WHEN regexp_matches(lower(path), '\.png$') THEN 'binary name' WHEN {_SECRET} THEN 'sensitive path' WHEN length(path) * 40000 > 1048576 THEN 'too large' END AS reason FROM p""",
    "hard_links": rf"WITH {PATHS_SQL}, x AS (SELECT path, length(path) % 20 AS ino, length(path) % 2 = 0 AS linked, ({_SECRET}) AS secret FROM p) SELECT path, ino FROM x WHERE NOT secret AND ino NOT IN (SELECT ino FROM x WHERE secret AND linked)",
    "match_lines": HIT_SQL + " SELECT replace(path, ':markdown:', '/') AS path, line_no, content FROM m",
    "render_matches": HIT_SQL + " SELECT path, string_agg(path || ':' || line_no || ':' || content, chr(10) ORDER BY line_no) AS rendered FROM m GROUP BY path",
    "control_bytes": "SELECT doc_id, doc_id % 3 = 0 OR regexp_matches(coalesce(text, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]') AS control FROM documents",
}
QUERIES = [files_indexable, skip_reasons, index_files, hard_links, match_lines, render_matches, control_bytes]

