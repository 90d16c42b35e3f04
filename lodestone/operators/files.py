"""File intake and line formats: what may be indexed, hard links, scan caps, match lines, rendered summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gates import has_secret, has_segment, is_binary_content, is_binary_name, is_sensitive_path
from ..functions.paths import glob_match
from .store import within_caps

#: The intake's limits.
MAX_DEPTH, MAX_FILES, MAX_FILE_BYTES, MAX_TOTAL_BYTES = 32, 5000, 1 << 20, 100 << 20
WALK_SKIPS = (".git", "node_modules")
SCAN_CAP = 100_000


def indexable(files: DataFrame) -> DataFrame:
    """(path, size, ...) that pass the cheap gates by name, depth and size; contents are not read for these."""
    path = F.col("path")
    shallow = F.size(F.split(path, "/")) - 1 <= MAX_DEPTH
    return files.filter(shallow & ~has_segment(path, WALK_SKIPS) & ~is_binary_name(path) & ~is_sensitive_path(path) & (F.col("size") <= MAX_FILE_BYTES))


def skip_reasons(files: DataFrame) -> DataFrame:
    """Why a file is not indexed, the first reason that holds; null if it is."""
    path = F.col("path")
    reason = (
        F.when(has_segment(path, WALK_SKIPS), "skipped directory")
        .when(F.size(F.split(path, "/")) - 1 > MAX_DEPTH, "too deep")
        .when(is_binary_name(path), "binary name")
        .when(is_sensitive_path(path), "sensitive path")
        .when(F.col("size") > MAX_FILE_BYTES, "too large")
    )
    return files.select("path", reason.alias("reason"))


def index_files(files: DataFrame, now: int) -> DataFrame:
    """Rows (path, content, indexed_at, size) of files (path, size, content: binary) within the caps and gates.

    The content gates come last, so that most files are out before their bytes are looked at.
    """
    few = within_caps(indexable(files).select("path", "size"), MAX_FILES, MAX_FILE_BYTES, MAX_TOTAL_BYTES).select("path")
    text = files.join(few, "path", "left_semi").filter(~is_binary_content(F.col("content"))).select("path", F.decode("content", "UTF-8").alias("content"), "size")
    return text.filter(~has_secret(F.col("content"))).withColumn("indexed_at", F.lit(now).cast("long"))


def not_linked_to_secrets(files: DataFrame) -> DataFrame:
    """Files (path, dev, ino, nlink) without a hard link under a sensitive name: an anti-join on identity."""
    secret = files.filter((F.col("nlink") > 1) & is_sensitive_path(F.col("path"))).select("dev", "ino").distinct()
    return files.join(secret, ["dev", "ino"], "left_anti").filter(~is_sensitive_path(F.col("path")))


def capped_scan(paths: DataFrame, cap: int = SCAN_CAP) -> tuple[DataFrame, bool]:
    """The first ``cap`` paths by name and whether there are more."""
    more = paths.select("path").limit(cap + 1).count() > cap
    return paths.orderBy("path").limit(cap), more


def parse_match_line(line: Column) -> dict[str, Column]:
    """``path:line:content`` split at the first number between colons; nulls for headers and separators."""
    is_match = line.rlike(r"^.*?:[0-9]+:") & ~line.rlike(r"^(?:engine=|\.\.\.|--$|\[)")
    take = lambda k: F.when(is_match, F.regexp_extract(line, r"(?s)^(.*?):([0-9]+):(.*)$", k))
    return {"path": take(1), "line_no": take(2).cast("long"), "content": take(3)}


def render_matches(hits: DataFrame) -> DataFrame:
    """One text per file of ``path:line:content`` lines in order."""
    line = F.concat_ws(":", "path", F.col("line_no").cast("string"), "content")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", line.alias("text"))))
    return hits.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("rendered"))


def has_control_bytes(text: Column) -> Column:
    """Control characters other than tab, line feed and carriage return."""
    return text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def dirty_first(paths: DataFrame, dirty: DataFrame, pattern: str) -> DataFrame:
    """Paths that fit a glob, changed ones first, otherwise by name."""
    hits = paths.filter(glob_match(F.col("path"), pattern)).join(dirty.select("path", F.lit(1).alias("_d")), "path", "left")
    return hits.orderBy(F.col("_d").isNull(), "path").drop("_d")
