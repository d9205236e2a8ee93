"""Operators that hold no group in one task: ranks in ranges, resamples that add up, draws without pairs."""

import collections
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.operators import assign, curves, metrics


def test_one_huge_condition_in_many_tasks(spark):
    """Two million distinct scores of one condition, ties among them, beside small conditions: equal to the sums of plain NumPy, and to the windows of small ones."""
    n = 2_000_000
    p = spark.range(n).select(F.lit("big").alias("k"), (F.xxhash64("id") % 2 == 0).cast("int").alias("y_true"), (F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1 << 50)) / float(1 << 50)).alias("y_score"))
    p = p.withColumn("y_score", F.when(F.col("y_score") < 0.1, F.round("y_score", 3)).otherwise(F.col("y_score")))
    small = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.5), ("a", 1, 0.7), ("b", 1, 0.1), ("c", 0, 0.2), ("c", 1, 0.1)], "k string, y_true int, y_score double")
    both = p.unionByName(small)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that ranges are as many as partitions
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        got = {r.k: r for r in metrics.binary_metrics(both, ["k"], True).collect()}
        ranges = both.repartitionByRange("k", "y_score").groupBy(F.spark_partition_id().alias("r")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(ranges) == 16 and max(r["count"] for r in ranges) < n / 8
    rows = p.toPandas()
    y, s = rows["y_true"].to_numpy(), rows["y_score"].to_numpy()
    values, inverse, counts = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    n1 = int(y.sum())
    assert math.isclose(got["big"].roc_auc, (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (n - n1)), rel_tol=1e-12)
    for r in metrics.binary_metrics(small, ["k"]).collect():
        assert got[r.k].asDict() == pytest.approx(r.asDict())


def test_resamples_add_up(spark):
    """Any partitioning gives the same means; a resample takes each row as often as a Poisson draw, and limits are those of the usual bootstrap, nearly."""
    r = np.random.default_rng(4)
    v = r.normal(3, 2, 400)
    df = spark.createDataFrame([("g", f"i{k}", float(x)) for k, x in enumerate(v)] + [("g", "nan", float("nan")), ("g", "null", None), ("h", "one", 5.0)], "k string, id string, v double")
    means = [sorted((x.k, x.b, round(x.m, 9)) for x in curves.resampled_means(df.repartition(p, "id"), ["k"], "v", F.col("id"), 402, 9).collect()) for p in (1, 7)]
    assert means[0] == means[1] and {b for k, b, _ in means[0] if k == "g"} == set(range(1, 403))
    assert {m for k, _, m in means[0] if k == "h"} == {5.0} and 0.5 < sum(k == "h" for k, *_ in means[0]) / 402 < 0.75  # 1 - 1/e
    got = {x.k: x for x in curves.merged_bootstrap(df, ["k"], "v", F.col("id"), 2000, 9).collect()}
    want = np.quantile(r.choice(v, (2000, len(v))).mean(1), [0.025, 0.975])
    assert np.allclose([got["g"].ci_low, got["g"].ci_high], want, atol=0.05)
    counted = curves.resampled_means(df.filter("k = 'g'").withColumn("v", F.lit(1.0)), ["k"], "v", F.col("id"), 8, 1)
    assert all(x.m == 1.0 for x in counted.collect())
    plan = curves.merged_bootstrap(df, ["k"], "v", F.col("id"), 8, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "array_sort" not in plan
    assert abs(Fraction(curves.TIMES[-1]) - 1) < 1e-8


def test_sources_are_drawn_evenly(spark):
    subjects = [("D", f"{k:02d}") for k in range(7)] + [("E", "00"), ("E", "01"), ("F", "00")]
    t = spark.createDataFrame(subjects * 2, "dataset string, subject string")
    seen = collections.Counter()
    for seed in range(60):
        rows = assign.drawn_sources(t, 3, seed).collect() if seed < 3 else assign.drawn_sources(t.filter("dataset = 'D'"), 3, seed).collect()
        of = collections.defaultdict(list)
        for x in rows:
            of[(x.dataset, x.target_subject)].append((x.place, x.source_subject))
        for (d, target), got in of.items():
            names = [s for _, s in sorted(got)]
            assert len(set(names)) == len(names) == (3 if d == "D" else 1) and target not in names and [p for p, _ in sorted(got)] == list(range(1, len(names) + 1))
            if d == "D":
                seen.update((target, s) for s in names)
        assert ("F", "00") not in of
    assert len(seen) == 42 and all(10 <= n <= 50 for n in seen.values())  # 60 * 3 / 6 each
    every = assign.drawn_sources(t, 2**31 - 1, 1).groupBy("dataset").count().collect()
    assert {r.dataset: r["count"] for r in every} == {"D": 42, "E": 2}
