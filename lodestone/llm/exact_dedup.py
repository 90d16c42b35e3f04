"""Exact deduplication by deterministic block naming (DataFrame functions only).

Each normalised text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted
into integer names, every text becomes a list of names, and adjacent pairs of names are named again,
level by level, until each text has a single name. Two texts have the same (level, name) if and only
if they are equal: names are given to distinct contents, never to hashes. A 64-bit hash only routes
rows to their name; hashes that two different blocks share are found and resolved by content.

Shuffled are every distinct block of a map task once (partial aggregation comes first) and a few
integers per block and level. Hot texts and hot blocks shrink before the shuffle; the joins that
bring names back are between written tables, so Spark can split a hot key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, strip_ascii_space

BLOCK_BYTES = 8192


def _named(distinct: DataFrame, by: list[str], sign: int = 1) -> DataFrame:
    """Distinct rows sorted into integer names; the order inside a partition makes a rerun agree."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.lit(sign) * (F.monotonically_increasing_id() + 1))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    route: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``. Of equal texts the
    row with the most code points in its original text stays, then the one with the smallest id.

    Defined cases: a null text counts as empty, and all empty texts are one group. A null id sorts
    after all others; if it wins, keep_id is null. Repeated rows (same id and text) are all returned
    and one of them is kept. An empty table gives an empty result. Other columns are ignored, so
    their names cannot clash. ``route`` is the routing hash; any function of the block is right.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    key = ["id", "n_cp", "sha"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.length(text).alias("n_cp"),
        strip_ascii_space(text).cast("binary").alias("norm"),
    )
    last = F.expr(f"greatest(0L, (octet_length(norm) - 1) div {block_bytes})")
    cut = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("pos")).select(
        "id", "n_cp", "norm", "pos",
        F.expr(f"substring(norm, cast(pos * {block_bytes} + 1 as int), {block_bytes})").alias("block"),
    ).withColumn("h", route(F.col("block")))

    names = scratch.put(_named(cut.select("h", "block").distinct(), ["block"]).select("h", "name"), "block-names")
    shared = names.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    mapped = rows.select("*", F.sha2("norm", 256).alias("sha"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("pos")).select(
        *key, "pos", F.expr(f"substring(norm, cast(pos * {block_bytes} + 1 as int), {block_bytes})").alias("block"),
    ).withColumn("h", route(F.col("block")))
    plain = mapped.select(*key, "pos", "h")
    if shared.isEmpty():
        level = plain.join(names, "h").select(*key, "pos", "name")
    else:  # different blocks under one hash: these rows are named by content
        single = plain.join(shared, "h", "left_anti").join(names, "h").select(*key, "pos", "name")
        clash = mapped.join(shared, "h", "left_semi")
        by_content = scratch.put(_named(clash.select("h", "block").distinct(), ["block"], -1), "clash-names")
        level = single.unionByName(clash.join(by_content, ["h", "block"]).select(*key, "pos", "name"))

    def regroup(df: DataFrame, *more: Column) -> DataFrame:
        ordered = F.transform(F.array_sort(F.collect_set(F.struct("pos", "name"))), lambda x: x["name"])
        return df.groupBy(*key).agg(ordered.alias("names"), *more)

    table = scratch.put(regroup(level, F.count_if(F.col("pos") == 0).alias("mult")), "names-0")
    done, depth = [], 0
    while True:
        done.append(table.filter("size(names) = 1").select(*key, "mult", F.lit(depth).alias("depth"), F.col("names")[0].alias("name")))
        active = table.filter("size(names) > 1")
        if active.isEmpty():
            break
        depth += 1
        pairs = active.select(
            *key, "mult", "names",
            F.explode(F.expr("sequence(0, (size(names) - 1) div 2)")).alias("pos"),
        ).select(*key, "mult", "pos", F.expr("names[2 * pos]").alias("l"), F.expr("coalesce(get(names, 2 * pos + 1), 0L)").alias("r"))
        pair_names = scratch.put(_named(pairs.select("l", "r").distinct(), ["l", "r"]), f"pair-names-{depth}")
        table = scratch.put(regroup(pairs.join(pair_names, ["l", "r"]), F.first("mult").alias("mult")), f"names-{depth}")

    final = done[0]
    for other in done[1:]:
        final = final.unionByName(other)
    best = F.min(F.struct((-F.col("n_cp")).alias("neg"), F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    groups = final.groupBy("depth", "name").agg(F.sum("mult").alias("group_size"), best.alias("best")).filter("group_size > 1")
    groups = scratch.put(groups.select("depth", "name", "group_size", F.col("best.id").alias("keep_id"), (-F.col("best.neg")).alias("keep_cp")), "groups")
    out = final.join(groups, ["depth", "name"], "left").select("*", F.explode(F.expr("sequence(1L, mult)")).alias("copy"))
    alone = F.col("group_size").isNull()
    return out.select(
        F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("keep_cp")) & (F.col("copy") == 1))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n
  FROM documents
), g AS (SELECT n, count(*) AS group_size FROM d GROUP BY n
), r AS (
  SELECT d.*, row_number() OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS rn,
         first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id
  FROM d
)
SELECT r.doc_id, r.keep_id, g.group_size, r.rn = 1 AS kept, sha256(r.n) AS text_sha256
FROM r JOIN g ON r.n = g.n
"""
