"""Exact quantiles against sorting."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinkline.operators import quantiles, summary

PROBS = {"q0": 0.0, "q05": 0.05, "q25": 0.25, "q50": 0.5, "q95": 0.95, "q1": 1.0}


def test_order_key_keeps_the_order(spark):
    values = [-math.inf, -1e300, -2.5, -2.0, -1e-310, -0.0, 0.0, 5e-324, 1e-10, 1.0, 1.0000000000000002, 7.0, 1e300, math.inf, math.nan]
    keys = [r.k for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", quantiles.order_key(F.col("v")).alias("k")).orderBy("i").collect()]
    assert keys == sorted(keys) and keys[5] == keys[6] and len(set(keys)) == len(values) - 1


def test_quantiles_of_groups_match_sorting(spark):
    rnd = random.Random(4)
    rows = [("many", rnd.choice([1.5, 2.5])) for _ in range(5_000)] + [("spread", rnd.lognormvariate(0, 40) * rnd.choice([-1, 1])) for _ in range(3_000)]
    rows += [("close", 1 + k * 2.220446049250313e-16) for k in range(100)] + [("one", 7.25), ("two", 1.0), ("two", 2.0), (None, 3.0), (None, 9.0), ("nulls", None), ("zeros", -0.0), ("zeros", 0.0), ("inf", math.inf), ("inf", 1.0), ("inf", math.inf)]
    got = {r.g: r for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", PROBS).collect()}
    groups = {g for g, v in rows if v is not None}
    assert set(got) == groups
    for g in groups - {"inf"}:
        own = [v for x, v in rows if x == g and v is not None]
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(float(np.percentile(own, 100 * p)), rel=1e-12, abs=1e-300), (g, name)
    assert got["inf"].q50 == math.inf and got["inf"].q0 == 1.0


def test_quantiles_of_whole_tables(spark):
    df = spark.range(1001).select((F.col("id") * 3 % 1001).cast("double").alias("v"))
    assert tuple(quantiles.exact_quantiles(df, [], "v", {"a": 0.1, "b": 0.5}).first()) == (100.0, 500.0)
    empty = df.filter("v < 0")
    assert quantiles.exact_quantiles(empty, [], "v", {"a": 0.5}).count() == 0
    assert tuple(summary.spread_report(empty, "v").first()) == (0, None, None, None)
    assert tuple(summary.draw_report(df.select((F.col("v") - 500).alias("v")), "v").first())[2:] == (0.0, -450.0, 450.0)


def test_a_large_group_is_counted_before_it_is_shuffled(spark):
    """A group of nearly all rows: a shuffle carries counts by leading bits, never the rows, and no
    aggregate keeps the values of a group."""
    df = spark.range(400_000, numPartitions=8).select(F.when(F.col("id") % 100 == 0, F.col("id") % 7).otherwise(0).alias("g"), (F.col("id") % 1000 / 4).alias("v"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("quantiles", "")
    out = quantiles.exact_quantiles(df, ["g"], "v", {"m": 0.5})
    rows = {r.g: r.m for r in out.collect()}
    jobs = tracker.getJobIdsForGroup("quantiles")
    spark.sparkContext.setJobGroup("other", "")
    assert len(rows) == 7 and jobs
    store = spark.sparkContext._jsc.sc().statusStore()
    most = 0
    for job in jobs:
        for stage in tracker.getJobInfo(job).stageIds:
            try:
                most = max(most, store.lastStageAttempt(stage).shuffleWriteRecords())
            except Exception:  # a stage that was skipped
                continue
    assert 0 < most < 40_000
    assert not re.search("percentile|collect_list", out._jdf.queryExecution().toString().lower())


def test_violin_of_null_and_missing_values(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, None), (2, None), (None, 4.0), (9, 1.0)], "k int, v double")
    rows = {r.kappa: r for r in summary.violin(df, "k", "v").collect()}
    assert set(rows) == {1, 2} and (rows[1].n, rows[1].q1, rows[1].median, rows[1].q3) == (2, 1.5, 2.0, 2.5) and rows[2].n == 0 and rows[2].median is None


def test_smallest_rows(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101 - 50 if i < 101 else None) for i in range(110)], "i int, k long")
    for n in (0, 1, 7, 100, 101, 500):
        got = sorted(r.k for r in quantiles.smallest(df, F.col("k"), n).collect())
        assert got == list(range(-50, -50 + min(n, 101)))
    ties = spark.createDataFrame([(1, "a")] * 5 + [(2, "b")] * 5, "k long, t string")
    assert [r.k for r in quantiles.smallest(ties, F.col("k"), 7).orderBy("k").collect()] == [1] * 5 + [2] * 2
    plan = quantiles.smallest(df, F.col("k"), 60)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "rangepartitioning" not in plan
