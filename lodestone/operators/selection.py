"""Exact percentiles of groups of any size: no group in one task, no values in memory.

A group with more than ``HEAVY`` of all rows (there are at most 1 / HEAVY) is searched by histograms: per wanted rank an interval that
holds it, counted in bins by every task, then narrowed to the bin of the rank, until its ends are equal. Only bins are shuffled. The
other groups are sorted by a window, which spills.
"""

from __future__ import annotations

import math
import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAVY, BINS = 1 / 1000, 2048


def _same(a: str, b: str, by: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by], F.lit(True))


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """A number that grows with the value, by its magnitude where an interval spans several, else in equal steps.

    The ends of an interval have different numbers, and so have the infinities and NaN, the greatest of all; a few passes separate any doubles.
    """
    most = sys.float_info.max
    low, high = F.greatest(lo, F.lit(-most)), F.least(hi, F.lit(most))
    width = high / 2 - low / 2
    even = F.when(width > 0, F.least(F.floor((v / 2 - low / 2) / width * bins), F.lit(bins))).otherwise(F.when(v <= low, 0).otherwise(bins))
    # logarithms of doubles lie between -745 and 710
    size = lambda x: F.when(x == 0, 0).otherwise(F.floor(F.signum(x) * (F.ln(F.abs(x)) + 746) * (bins / 3000)))
    inside = F.when(size(low) == size(high), even).otherwise(size(v))
    return F.when(F.isnan(v), bins + 2).when(v > most, bins + 1).when(v < -most, -bins - 1).otherwise(inside)


def _narrow(rows: DataFrame, targets: DataFrame, by: list[str], bins: int) -> DataFrame:
    """(by, rank, below, lo, hi) with the least and greatest value of the bin that holds the rank; below: values under lo."""
    t, r = F.broadcast(targets).alias("t"), rows.alias("r")  # at most 1 / HEAVY groups and a few ranks of each
    within = r.join(t, _same("r", "t", by) & F.col("_v").between(F.col("lo"), F.col("hi")))
    own = [F.col(f"t.{c}").alias(c) for c in by]
    counts = within.groupBy(*own, "rank", "below", _bin(F.col("_v"), F.col("lo"), F.col("hi"), bins).alias("_bin")).agg(F.count("*").alias("_n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    w = Window.partitionBy(*by, "rank").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # bins, not rows
    upto = counts.withColumn("_end", F.col("below") + F.sum("_n").over(w))
    return upto.filter((F.col("_end") - F.col("_n") <= F.col("rank")) & (F.col("rank") < F.col("_end"))).select(*by, "rank", (F.col("_end") - F.col("_n")).alias("below"), "lo", "hi")


def _settled(t) -> bool:
    """Whether the ends of an interval are one value; NaN is the greatest value, so a low end of NaN is the high end too."""
    return t["lo"] == t["hi"] or math.isnan(t["lo"])


def select_ranks(rows: DataFrame, ranks: DataFrame, by: list[str], total: int, heavy: float = HEAVY, bins: int = BINS) -> DataFrame:
    """(by, rank, value): the value at 0-based ranks of groups; rows have by and _v, ranks have by, rank, n, lo and hi of the group."""
    spark = rows.sparkSession
    large, small = ranks.filter(F.col("n") > heavy * total), ranks.filter(F.col("n") <= heavy * total)
    schema = ranks.select(*by, "rank", F.lit(0).cast("long").alias("below"), "lo", "hi").schema
    targets = large.select(*by, "rank", F.lit(0).cast("long").alias("below"), "lo", "hi").collect()  # bounded as above
    done = []
    while targets:
        done += [t for t in targets if _settled(t)]
        targets = [t for t in targets if not _settled(t)]
        if targets:
            targets = _narrow(rows, spark.createDataFrame(targets, schema), by, bins).collect()
    light = rows.alias("r").join(F.broadcast(large.select(*by).distinct()).alias("t"), _same("r", "t", by), "left_anti") if by else (rows.limit(0) if done else rows)
    by_bins = spark.createDataFrame(done, schema).select(*by, "rank", F.col("lo").alias("value"))
    of = small.groupBy(*by).agg(F.collect_set("rank").alias("_ranks"))
    w = Window.partitionBy(*[F.col(f"r.{c}") for c in by]).orderBy("_v")
    sorted_ = light.alias("r").join(of.alias("t"), _same("r", "t", by)).withColumn("rank", (F.row_number().over(w) - 1).cast("long"))
    by_sort = sorted_.filter(F.array_contains("_ranks", F.col("rank"))).select(*[F.col(f"r.{c}").alias(c) for c in by], "rank", F.col("_v").alias("value"))
    return by_bins.unionByName(by_sort)


def percentiles(rows: DataFrame, value: str, by: list[str], points=(0.5, 0.95, 0.99), heavy: float = HEAVY, bins: int = BINS) -> DataFrame:
    """p50, p95, ... of each group as the aggregate ``percentile`` gives them, by interpolation between two ranks; null values do not count, a group of nulls has nulls."""
    plain = rows.select(*by, F.col(value).cast("double").alias("_v"))
    groups = plain.groupBy(*by).agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    known, total = plain.filter("_v IS NOT NULL"), groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    at = lambda p: (F.col("n") - 1) * F.lit(float(p))
    wanted = F.array_distinct(F.array(*[f(at(p)).cast("long") for p in points for f in (F.floor, F.ceil)]))
    ranks = groups.filter("n > 0").select(*by, "n", "lo", "hi", F.explode(wanted).alias("rank"))
    values = select_ranks(known, ranks, by, total, heavy, bins).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_values"))

    def point(p: float) -> Column:
        low, high = F.floor(at(p)), F.ceil(at(p))
        a, b = F.try_element_at("_values", low), F.try_element_at("_values", high)
        return F.when(low == high, a).otherwise((high - at(p)) * a + (at(p) - low) * b).alias(f"p{round(p * 100)}")

    return groups.alias("r").join(values.alias("t"), _same("r", "t", by), "left").select(*[F.col(f"r.{c}").alias(c) for c in by], *[point(p) for p in points])
