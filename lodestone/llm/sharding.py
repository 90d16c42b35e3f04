"""Sharding by a k-d tree over document metadata (DataFrame functions only).

A node is split at a weighted median (weight: bytes) along the dimension in which it is widest, until
its bytes reach the target. The median is found in a distributed way: the ordering key of every
row is a list of 12-bit digits (the dimension, then a hash of the text, then a hash of the id); one
small aggregate per digit gives the bytes of at most 4096 bins per node, and the search goes down into
the bin that holds the median until that bin is light enough to go to one side whole. All nodes of
a level are searched together, so a level costs a few passes over a narrow table and the driver only
sees bins, never rows.

Equal texts share the metadata of their first row and the hash of their text, so they stay in one
shard, except a group so heavy that keeping it whole would leave the shards unequal: the id digits
split that one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BITS = 12
MASK = (1 << BITS) - 1
#: Digits of the dimension, of the text's hash, of the id's hash.
DIM_DIGITS, TEXT_DIGITS, ID_DIGITS = 2, 3, 3
DIM_MAX = (1 << (BITS * DIM_DIGITS)) - 1


def _dimensions(categories: list[str], numbers: list[str]) -> dict[str, Column]:
    """Raw coordinates; categories go by a hash of their name, null by 0."""
    out = {f"d_{c}": F.coalesce(F.crc32(F.col(f"g_{c}").cast("binary")), F.lit(0)).cast("double") for c in categories}
    return out | {f"d_{c}": F.coalesce(F.col(f"g_{c}").cast("double"), F.lit(0.0)) for c in numbers}


def kd_shards(
    docs: DataFrame,
    n_shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    categories: tuple[str, ...] = ("source", "lang"),
    numbers: tuple[str, ...] = ("log_size", "id"),
    tolerance: float = 0.0005,
    rows_per_bucket: int = 20_000,
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 bytes plus 1; the target of a leaf is total size / n_shards.
    ``tolerance`` is the share of a node's bytes that may go to one side without a finer search.
    ``numbers`` may name numeric columns, ``log_size`` and ``id``; ``slot`` counts from 0 without gaps
    in each shard.

    Defined cases: a null text has no bytes (size 1, checksum 0); null metadata count as 0; a null or
    non-numeric id gives 0 in the id dimension; repeated rows get one slot each; with fewer rows than shards some shards
    stay empty; an empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "kd-shards")
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    extra = [c for c in (*categories, *numbers) if c not in ("log_size", "id")]
    meta = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("crc"),
        F.xxhash64(raw).alias("h"),
        *[F.col(c).alias(f"m_{c}") for c in extra],
    )
    meta = scratch.put(meta, "meta")
    first = F.struct(F.col("id").isNull().alias("none"), "id", *[f"m_{c}" for c in extra])
    group = ["h", "crc", "size"]
    reps = meta.groupBy(*group).agg(F.min(first).alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    reps = scratch.put(reps, "groups")
    joined = meta.join(reps, group, "left")
    own = lambda c: F.when(F.col("rep").isNull(), F.col(c)).otherwise(F.col(f"rep.{c}"))
    pick = {"log_size": F.log2(F.col("size")), "id": own("id").try_cast("double")} | {c: own(f"m_{c}") for c in extra}
    dims = _dimensions([c for c in categories], [c for c in numbers])
    coords = joined.select("id", "size", "crc", "h", *[pick[c].alias(f"g_{c}") for c in (*categories, *numbers)])
    coords = coords.select("id", "size", "crc", "h", *[v.alias(k) for k, v in dims.items()])

    names = list(dims)
    coords = scratch.put(coords, "coords")
    whole = coords.agg(F.sum("size").alias("total"), F.count("*").alias("n"), *[f(k).alias(f"{w}_{k}") for k in names for w, f in (("lo", F.min), ("hi", F.max))]).first()
    total, n_rows = whole["total"] or 0, whole["n"]

    def scaled(k: str) -> Column:
        lo, hi = whole[f"lo_{k}"] or 0.0, whole[f"hi_{k}"] or 0.0
        if hi <= lo:
            return F.lit(0).cast("long")
        return F.floor((F.col(k) - lo) / (hi - lo) * DIM_MAX).cast("long")

    keyed = coords.select(
        "id", "size", "crc", *[scaled(k).alias(k) for k in names],
        F.shiftrightunsigned("h", 64 - BITS * TEXT_DIGITS).alias("t"),
        F.shiftrightunsigned(F.xxhash64("id", "h"), 64 - BITS * ID_DIGITS).alias("i"), "h",
    )
    keyed = scratch.put(keyed.withColumn("node", F.lit(1)), "keyed")
    scratch.drop(meta, coords)

    # active: node -> number of shards still to be made of it
    active, first_shard, finished = {1: n_shards}, {1: 0}, []
    while active:
        todo = {}
        for node, m in active.items():
            (todo.__setitem__(node, m) if m > 1 else finished.append(node))
        if not todo or not n_rows:
            break
        cuts = _cuts(keyed, todo, names, tolerance)
        when = None
        active = {}
        for node, m in todo.items():
            left = m // 2
            right_side = _right(cuts[node])
            child = F.when(right_side, F.lit(2 * node + 1)).otherwise(F.lit(2 * node))
            when = F.when(F.col("node") == node, child) if when is None else when.when(F.col("node") == node, child)
            active |= {2 * node: left, 2 * node + 1: m - left}
            first_shard |= {2 * node: first_shard[node], 2 * node + 1: first_shard[node] + left}
        before, keyed = keyed, scratch.put(keyed.withColumn("node", when.otherwise(F.col("node"))), "keyed")
        scratch.drop(before)
    if not finished:
        finished = [1]
    shard = reduce(lambda acc, n: acc.when(F.col("node") == n, F.lit(first_shard[n])), finished, F.when(F.lit(False), F.lit(0)))
    placed = scratch.put(keyed.select("id", "size", "crc", "h", shard.cast("int").alias("shard")), "placed")

    buckets = max(1, math.ceil(n_rows / rows_per_bucket) * 4)
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("id", "h"), F.lit(buckets)).cast("int"))
    per = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.expr("sum(n) OVER (PARTITION BY shard ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)") - F.col("n")
    starts = per.select("shard", "bucket", before.alias("start"))
    at = F.expr("row_number() OVER (PARTITION BY shard, bucket ORDER BY id, h)")
    return placed.withColumn("at", at).join(starts, ["shard", "bucket"]).select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("start") + F.col("at") - 1).cast("long").alias("slot"),
    )


def _digit(dim: str, k: int) -> Column:
    """The k-th 12-bit digit of a row's ordering key along ``dim``."""
    for column, count in ((dim, DIM_DIGITS), ("t", TEXT_DIGITS), ("i", ID_DIGITS)):
        if k < count:
            return F.shiftright(F.col(column), BITS * (count - 1 - k)).bitwiseAND(MASK).cast("int")
        k -= count
    raise IndexError(k)


def _right(cut: dict) -> Column:
    """True for rows behind the cut: their digits are greater than the cut's."""
    out = F.lit(False)
    for k in reversed(range(len(cut["prefix"]))):
        d = _digit(cut["dim"], k)
        out = (d > cut["prefix"][k]) | ((d == cut["prefix"][k]) & out)
    return out


def _cuts(keyed: DataFrame, todo: dict[int, int], names: list[str], tolerance: float) -> dict[int, dict]:
    """A cut for every node of a level: its dimension and the digits of the last row to the left."""
    ranges = keyed.groupBy("node").agg(F.sum("size").alias("w"), *[(F.max(k) - F.min(k)).alias(k) for k in names])
    cuts: dict[int, dict] = {}
    for r in ranges.filter(F.col("node").isin(list(todo))).collect():
        dim = max(names, key=lambda k: (r[k], -names.index(k)))
        cuts[r["node"]] = {"dim": dim, "prefix": [], "before": 0, "want": r["w"] * (todo[r["node"]] // 2) / todo[r["node"]], "weight": r["w"], "open": True}
    for node in todo:
        cuts.setdefault(node, {"dim": names[0], "prefix": [], "open": False})
    for k in range(DIM_DIGITS + TEXT_DIGITS + ID_DIGITS):
        searched = {n: c for n, c in cuts.items() if c["open"]}
        if not searched:
            break
        when, keep = None, F.lit(False)
        for node, c in searched.items():
            here = F.col("node") == node
            for j, d in enumerate(c["prefix"]):
                here = here & (_digit(c["dim"], j) == d)
            digit = _digit(c["dim"], k)
            when = F.when(here, digit) if when is None else when.when(here, digit)
            keep = keep | here
        rows = keyed.filter(keep).groupBy("node", when.alias("digit")).agg(F.sum("size").alias("w")).collect()
        for node, c in searched.items():
            at, chosen = c["before"], None
            for digit, w in sorted((r["digit"], r["w"]) for r in rows if r["node"] == node):
                chosen = digit, w, at
                if at + w >= c["want"]:
                    break
                at += w
            digit, w, at = chosen
            light = w <= tolerance * c["weight"] and k >= DIM_DIGITS - 1
            if light or k == DIM_DIGITS + TEXT_DIGITS + ID_DIGITS - 1 or at + w == c["want"]:
                left_whole = at + w - c["want"] <= c["want"] - at
                c["prefix"].append(digit if left_whole else digit - 1)
                c["open"] = False
            else:
                c["prefix"].append(digit)
                c["before"] = at
    return cuts
