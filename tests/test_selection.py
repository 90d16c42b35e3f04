"""Exact percentiles and stretches against the plain aggregate and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import selection, usage

POINTS = (0.0, 0.25, 0.5, 0.95, 1.0)


@pytest.mark.parametrize(("heavy", "bins"), [(0.0, 2048), (0.2, 64)])
def test_percentiles_equal_the_aggregate(spark, heavy, bins):
    rng = random.Random(9)
    values = [0.0, -0.0, 1.0, 1e-310, 5e-324, -1e300, 1.7e308, float("inf"), float("-inf"), float("nan"), 3.25]
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice(values) if rng.random() < 0.5 else rng.gauss(0, 1)) for _ in range(300)]
    rows += [("one", 7.0), ("nulls", None), ("twice", 1.0), ("twice", None), ("twice", 2.0)] + [("flat", 4.0)] * 50
    frame = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = selection.percentiles(frame, "v", ["g"], POINTS, heavy, bins).collect()
    want = frame.groupBy("g").agg(*[F.percentile("v", F.lit(p)).alias(f"p{round(p * 100)}") for p in POINTS]).collect()
    text = lambda rs: sorted(repr(tuple(0.0 if x == 0 else x for x in r)) for r in rs)
    assert text(got) == text(want)
    assert selection.percentiles(frame.limit(0), "v", ["g"], POINTS, heavy, bins).count() == 0


def test_percentiles_without_groups(spark):
    frame = spark.createDataFrame([(float(k % 7),) for k in range(50)], "v double")
    for heavy in (0.0, 1.0):
        got = selection.percentiles(frame, "v", [], (0.5, 0.9), heavy).first()
        assert tuple(got) == tuple(frame.agg(F.percentile("v", F.lit(0.5)), F.percentile("v", F.lit(0.9))).first())


def test_stretches_end_at_pauses(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(4000) * 100_000) for _ in range(200)]
    got = usage.stretches(spark.createDataFrame(rows, "k string, us long"), "k", "us", 10).collect()
    assert len(got) == len(rows)
    for k in ("a", "b", None):
        own = sorted((r["us"], r["_stretch"]) for r in got if r["k"] == k)
        for (u, x), (v, y) in zip(own, own[1:], strict=False):
            assert x == y or v - u >= 10_000_000, (u, v)
        assert len({x for _, x in own}) > 1
