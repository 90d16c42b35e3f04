"""Sources: audit logs, legacy documents, file trees, porcelain status text, and the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import new_folder


def audit_schema() -> T.StructType:
    """The fixed key set of a call record."""
    s, n, b = T.StringType(), T.LongType(), T.BooleanType()
    command = T.StructType([T.StructField(c, t) for c, t in (("label", s), ("exit_code", n), ("screen_verdict", s), ("screen_rule", s), ("indexed", b), ("index_label", s))])
    fields = [(c, s) for c in ("timestamp", "session_id", "caller", "tool", "action", "command", "cwd", "index_label", "error", "error_class", "screen_verdict", "screen_rule")]
    fields += [(c, n) for c in ("exit_code", "duration_ms", "output_len")] + [(c, b) for c in ("truncated", "indexed")]
    fields += [("audit_tags", T.ArrayType(s)), ("env_keys", T.ArrayType(s)), ("commands", T.ArrayType(command))]
    return T.StructType([T.StructField(c, t) for c, t in fields])


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """A log of one JSON object a line; blank and malformed lines are skipped."""
    return spark.read.schema(audit_schema()).option("mode", "DROPMALFORMED").json(path)


def write_audit(calls: DataFrame, path: str, records_per_file: int = 100_000) -> None:
    calls.write.mode("append").option("maxRecordsPerFile", records_per_file).json(path)


#: Fixed value: the size at which a log begins a new file.
ROLL_BYTES = 32 << 20


def generations(calls: DataFrame, order: list[str], roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """(generation, place, line): the calls as JSON lines in order; a line's generation is that of the bytes before it, ``roll_bytes`` each.

    Rows are dealt by ranges of their order and written once, so that the ranges stay; the bytes of each range (one number a task) are summed
    before them, and lines are placed within their range.
    """
    spark, line = calls.sparkSession, F.to_json(F.struct(*calls.columns))
    keys = [f"_o{k}" for k in range(len(order))]
    rows = calls.select(*[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)], line.alias("line")).withColumn("_n", F.octet_length("line") + 1)
    staging = new_folder(spark, "audit")
    rows.repartitionByRange(*keys, "line").withColumn("_part", F.spark_partition_id()).write.parquet(staging)
    dealt = spark.read.parquet(staging)
    parts = dealt.groupBy("_part").agg(F.sum("_n").alias("_size"))
    before = parts.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    upto = F.sum("_n").over(Window.partitionBy("_part").orderBy(*keys, "line").rowsBetween(Window.unboundedPreceding, -1))
    placed = dealt.withColumn("_upto", F.coalesce(upto, F.lit(0))).join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_upto"))
    return placed.select(F.floor(F.col("place") / roll_bytes).cast("long").alias("generation"), "place", "line")


def write_rolled(calls: DataFrame, folder: str, batch: int, order: list[str], roll_bytes: int = ROLL_BYTES) -> None:
    """Appends calls as JSON lines, one file per generation of about ``roll_bytes`` (never more than that and a line), in order.

    A batch has a folder of its own that is complete or absent for readers, and written again it replaces itself: nothing is lost or doubled by a retry.
    """
    lines = generations(calls, order, roll_bytes).repartition("generation").sortWithinPartitions("generation", "place")
    lines.select("generation", F.col("line").alias("value")).write.mode("overwrite").partitionBy("generation").text(f"{folder}/batch={batch}")


def legacy_documents(raw: DataFrame, text_col: str = "json") -> DataFrame:
    """(path, content) of JSON objects key -> document; entries that are no strings or have a bad key are left out."""
    entries = raw.select(F.explode(F.from_json(F.col(text_col), "map<string,string>")).alias("path", "content"))
    return entries.filter((F.col("path") != "") & ~F.col("path").contains("\x00") & F.col("content").isNotNull())


def scan_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, size, modified[, content]) of a tree; without content only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    out = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    return out


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def list_dir(paths: DataFrame, root: str, max_depth: int = 1, limit: int = 200, hidden: bool = False) -> DataFrame:
    """Files and folders under a root down to a depth (1 to 5), by path: path, name, is_dir, depth."""
    if not 1 <= max_depth <= 5:
        raise ValueError("depth must be 1 to 5")
    prefix = root.rstrip("/") + "/" if root not in ("", ".") else ""
    rel = paths.filter(F.col("path").startswith(prefix)).select(F.substr("path", F.lit(len(prefix) + 1)).alias("rel"))
    parts = rel.select("rel", F.split("rel", "/").alias("parts")).select("rel", "parts", F.explode(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(max_depth)))).alias("depth"))
    rows = parts.select(F.concat(F.lit(prefix), F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/")).alias("path"), F.get("parts", F.col("depth") - 1).alias("name"), (F.col("depth") < F.size("parts")).alias("is_dir"), "depth", "rel").distinct()
    rows = rows.groupBy("path", "name", "depth").agg(F.bool_or("is_dir").alias("is_dir"))
    if not hidden:
        rows = rows.filter(~F.concat(F.lit("/"), F.substr("path", F.lit(len(prefix) + 1))).contains("/."))
    return rows.orderBy("path").limit(limit)


def parse_porcelain(raw: DataFrame, text_col: str = "status") -> DataFrame:
    """(path, tag) of NUL-separated short status text; the old name of a rename or copy is no entry."""
    # an entry of a rename or copy consumes the next one, so a fold walks the entries
    entries = F.split(F.col(text_col), "\x00")
    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("kept"))
    step = lambda acc, e: F.struct(
        F.when(acc["skip"], F.lit(False)).otherwise(F.left(e, F.lit(2)).rlike("[RC]")).alias("skip"),
        F.when(acc["skip"] | (F.length(e) < 4), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(e))).alias("kept"),
    )
    kept = raw.select(F.explode(F.aggregate(entries, start, step, lambda acc: acc["kept"])).alias("e"))
    x, y = F.substring("e", 1, 1), F.substring("e", 2, 1)
    tag = (
        F.when(F.left("e", F.lit(2)) == "??", "??")
        .when(x.isin("M", "T", "U", "D") | y.isin("M", "T", "U", "D"), "M")
        .when(x.isin("A", "R", "C") | (y == "A"), "A")
        .when((x != " ") | (y != " "), "M")
    )
    return kept.select(F.substr("e", F.lit(4)).alias("path"), tag.alias("tag")).filter("tag IS NOT NULL")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kb_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as rows of the store: path, content."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws(":", "source", F.lit("markdown"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
