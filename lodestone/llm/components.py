"""Connected components by alternating large and small stars, on written tables."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node of an edge list (a, b); comp is the component's least node.

    Each round links neighbours to the least node they know; the list never grows and a star hangs on
    every component's least node at the end. Self-loops and repeated edges do no harm.
    """
    now, mark = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), None
    for k in itertools.count():  # ends: every round but the last brings some node nearer to its component's least one
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        now = scratch.put(small, f"stars-{k}")
        before, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select(F.col("v"), F.col("v")).distinct())
