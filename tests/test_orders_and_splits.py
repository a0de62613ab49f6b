"""Exact order statistics by refined ranges, and splits judged by bit masks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taproom.operators import evaluation, feedback


@pytest.mark.parametrize("lines", [2, 5, 1024])
def test_percentiles_are_exact(spark, lines):
    rand = random.Random(lines)
    groups = {
        "even": [float(i) for i in range(700)], "heavy": [rand.lognormvariate(0, 6) for _ in range(900)], "one": [7.0],
        "equal": [3.5] * 400, "two": [1.0, 2.0], "near": [1e300, -1e300, 0.0, 1e-300, 5e-324], None: [4.0, 4.0, 9.0],
        "ties": [float(rand.randrange(4)) for _ in range(500)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("empty", None)]
    rand.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, v double").repartition(3)
    shares = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}
    got = {r.g: r for r in evaluation.percentiles(frame, "v", "g", shares, lines).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, p in shares.items():
            assert got[g][name] == pytest.approx(np.quantile(vs, p), rel=1e-12), (g, name)


def test_a_large_group_is_never_held_whole(spark):
    frame = spark.range(400_000).select((F.pmod(F.xxhash64("id"), F.lit(10**9)) / 7).alias("v"))
    want = frame.agg(F.percentile("v", 0.5).alias("m"), F.percentile("v", 0.95).alias("p")).first()
    got = evaluation.percentiles(frame, "v", None, {"m": 0.5, "p": 0.95})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan
    assert (got.first().m, got.first().p) == pytest.approx((want.m, want.p), rel=1e-12)


def test_summary_of_empty_input(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert [tuple(r) for r in evaluation.latency_summary(none, "v").collect()] == [(0, None, None, None)]
    assert evaluation.latency_summary(none, "v", "g").collect() == []


def plain_seed(spark, rows, share, tries, seed):
    """First seed under which both sides have both labels, tried one by one."""
    frame = spark.createDataFrame(rows, "queryGroup string, label int")
    for s in range(seed, seed + tries):
        part = F.pmod(F.xxhash64(F.col("queryGroup"), F.lit(s)), F.lit(1_000_000))
        marked = frame.withColumn("t", part < int(share * 1_000_000))
        sides = marked.groupBy("t").agg(F.countDistinct("label").alias("n")).collect()
        if len(sides) == 2 and all(r.n == 2 for r in sides):
            return sorted((r.queryGroup, r.label, r.t) for r in marked.collect())
    return None


@pytest.mark.parametrize("n,share,tries", [(2, 0.3, 4), (3, 0.3, 70), (6, 0.1, 100), (40, 0.3, 1)])
def test_masks_choose_the_first_good_seed(spark, n, share, tries):
    rand = random.Random(n)
    rows = [(f"g{i}", label) for i in range(n) for label in ((0, 1) if i % 3 else (rand.randrange(2),))]
    want = plain_seed(spark, rows, share, tries, 42)
    split = feedback.grouped_split(spark.createDataFrame(rows, "queryGroup string, label int"), share, tries)
    assert (None if split is None else sorted(map(tuple, split.collect()))) == want


def test_no_split_without_two_groups(spark):
    assert feedback.grouped_split(spark.createDataFrame([("a", 0), ("a", 1)], "queryGroup string, label int")) is None
    assert feedback.grouped_split(spark.createDataFrame([], "queryGroup string, label int")) is None
