"""Line search: matches, context, groups, paging, ranked summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gates import has_secret, is_sensitive_path
from ..functions.text import is_definition, tag_definition


def lines(files: DataFrame, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """(path, line_no, content) with lines from 1; a trailing line break gives no extra line."""
    body = F.regexp_replace(F.col(text_col), r"\r?\n$", "")
    return files.select(F.col(path_col).alias("path"), F.posexplode(F.split(body, r"\r?\n"))).select("path", (F.col("pos") + 1).alias("line_no"), F.col("col").alias("content"))


def line_match(content: Column, pattern: str, literal: bool = False, ignore_case: bool = False) -> Column:
    if literal:
        return F.lower(content).contains(pattern.lower()) if ignore_case else content.contains(pattern)
    return content.rlike(("(?i)" if ignore_case else "") + "(?d)" + pattern)


def grep(files: DataFrame, pattern: str, literal: bool = False, ignore_case: bool = False, per_file: int | None = None) -> DataFrame:
    """Matching lines of files whose path is not sensitive; at most ``per_file`` in each."""
    hits = lines(files.filter(~is_sensitive_path(F.col("path")))).filter(line_match(F.col("content"), pattern, literal, ignore_case))
    if per_file:
        hits = hits.withColumn("_k", F.row_number().over(Window.partitionBy("path").orderBy("line_no"))).filter(F.col("_k") <= per_file).drop("_k")
    return hits


def grep_context(files: DataFrame, pattern: str, before: int = 2, after: int = 2, **how) -> DataFrame:
    """Matches with the lines around them, each line once: path, line_no, content, is_match; none of sensitive paths."""
    parts = F.split(F.regexp_replace("content", r"\r?\n$", ""), r"\r?\n")
    found = F.exists(parts, lambda x: line_match(x, pattern, **how))  # files without a match end here, before any sort
    all_lines = lines(files.filter(~is_sensitive_path(F.col("path")) & found)).withColumn("is_match", line_match(F.col("content"), pattern, **how))
    near = Window.partitionBy("path").orderBy("line_no").rowsBetween(-after, before)
    return all_lines.withColumn("_near", F.max(F.col("is_match").cast("int")).over(near)).filter("_near = 1").drop("_near")


def group_lines(hits: DataFrame) -> DataFrame:
    """One row per file: hits, first line, whether a definition is among them."""
    return hits.groupBy("path").agg(F.count("*").alias("hits"), F.min("line_no").alias("first_line"), F.bool_or(is_definition(F.col("content"))).alias("has_def"))


def with_dirty(groups: DataFrame, dirty: DataFrame) -> DataFrame:
    """Left join with (path, tag) of changed files."""
    return groups.join(dirty.select("path", "tag"), "path", "left").withColumn("dirty", F.col("tag").isNotNull())


def summary(groups: DataFrame, limit: int = 25) -> DataFrame:
    """Changed files first, then by hits, then by path."""
    return groups.orderBy(F.col("dirty").desc(), F.col("hits").desc(), "path").limit(limit)


def first_lines(hits: DataFrame, n: int = 2) -> DataFrame:
    """The first n matches of each file with definitions marked, and how many more there are."""
    by = Window.partitionBy("path")
    ranked = hits.withColumn("k", F.row_number().over(by.orderBy("line_no"))).withColumn("more", F.greatest(F.lit(0), F.count("*").over(by) - n))
    return ranked.filter(F.col("k") <= n).select("path", "line_no", tag_definition(F.ltrim("content")).alias("preview"), "more")


def page(hits: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of the flat list of matches by path and line; pages end at the five-hundredth."""
    if offset + limit > 500:
        raise ValueError("offset + limit exceeds 500")
    return hits.orderBy("path", "line_no").offset(offset).limit(limit)


def first_hits(context: DataFrame, limit: int) -> DataFrame:
    """The first matches in order of files and lines, with their context.

    Files are taken whole while their matches fit. Of the file in which the limit is reached come the lines in front of the last
    match and those that follow it without a gap, up to the next match; nothing of later files. At most ``limit`` files are ranked.
    """
    files = context.groupBy("path").agg(F.count_if("is_match").alias("_hits")).filter("_hits > 0").orderBy("path").limit(limit)
    before = F.sum("_hits").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    files = files.withColumn("_room", F.lit(limit) - F.coalesce(before, F.lit(0))).filter("_room > 0")
    by = Window.partitionBy("path").orderBy("line_no")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = context.join(F.broadcast(files), "path").withColumn("_n", F.count_if("is_match").over(upto))
    rows = rows.withColumn("_gap", F.coalesce(F.col("line_no") - F.lag("line_no").over(by) > 1, F.lit(False)))
    cut = F.count_if((F.col("_n") >= F.col("_room")) & F.col("_gap") & ~F.col("is_match")).over(upto)
    keep = (F.col("_hits") <= F.col("_room")) | ((F.col("_n") <= F.col("_room")) & ((F.col("_n") < F.col("_room")) | (F.col("_cut") == 0)))
    return rows.withColumn("_cut", cut).filter(keep).select(*context.columns)


def counts(groups: DataFrame) -> DataFrame:
    return groups.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.count("*").alias("files"), F.count_if("dirty").alias("dirty"))


def withheld(hits: DataFrame) -> DataFrame:
    """Files of which a matching line holds a secret; only their names may be shown."""
    return hits.groupBy("path").agg(F.bool_or(has_secret(F.col("content"))).alias("secret")).filter("secret").select("path")


def log_tail(rows: DataFrame, key: str, order: str, n: int = 100) -> DataFrame:
    """The last n lines of each log, in order."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return rows.withColumn("_k", k).filter(F.col("_k") <= n).drop("_k")
