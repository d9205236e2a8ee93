"""Sources in their seeded order, where all pairs are hashed: in blocks, and the same as digest by digest."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tamarack import audit_queries, plans, report_queries  # noqa: F401
from tamarack import queries as own
from tamarack.operators import assign, digests, mixed
from tests.conftest import SF


def by_digests(subjects, most, seed):
    order = lambda t: sorted((hashlib.md5(f"{seed}:{t}:{x}".encode()).hexdigest(), x) for x in subjects if x != t)
    return {(t, x, k) for t in subjects for k, (_, x) in enumerate(order(t)[:most], 1)}


def test_heads_of_digests():
    texts = [bytes([(3 * k + j) % 256 for j in range(k % 70)]) for k in range(digests.FEW + 70)]
    for few in (texts, texts[:20], []):
        ends = digests.Endings(few)
        for n in (0, 1, 2, 3, 15, 16, 52, 55, 56, 64, 90):
            start = bytes(range(n))
            assert ends.heads(start).tolist() == [int.from_bytes(hashlib.md5(start + t).digest()[:4], "big") for t in few]
    assert set(digests.Endings([b"a"] * 5 + [b"b"]).first(b"", 1)) in ({0, 1, 2, 3, 4}, {5})


@pytest.mark.parametrize("n", [1, 2, 40, 700])
def test_blocks_give_the_order_of_whole_digests(spark, monkeypatch, n):
    monkeypatch.setattr(assign, "TARGETS_AT_ONCE", 90)
    monkeypatch.setattr(assign, "SOURCES_AT_ONCE", 300)
    ids = {"A": [str(7 * k) for k in range(n)], "Ä": ["ü" * (k % 40) + str(k) for k in range(n)]}
    rows = [(d, x, k) for d, own in ids.items() for x in own for k in range(2)] + [("A", None, 0), (None, "7", 0)]
    t = spark.createDataFrame(rows, "dataset string, subject string, k int")
    got = {(r.dataset, r.target_subject, r.source_subject, r.place) for r in assign.sources(t, 10, 5).collect()}
    assert got == {(d, *x) for d, own in ids.items() for x in by_digests(own, 10, 5)}


def test_no_row_holds_a_dataset(spark):
    """A dataset's subjects were one array in each target's row, whose pairs were hashed in as many tasks as there are bytes for: one."""
    t = spark.range(5000).select(F.lit("D").alias("dataset"), F.col("id").cast("string").alias("subject"))
    chosen = assign.sources(t, 3, 1)
    assert chosen.count() == 15_000
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(subject" not in plan and "FlatMapGroupsInPandas" in plan


@pytest.mark.parametrize("name", ["source_detail_rules", "audit_sources", "assignment_reuse_gate"])
def test_pairs_are_made_once(spark, name):
    """Rules that read the same pairs made them anew, each for itself."""
    df = own.QUERIES[name](spark, SF)
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().optimizedPlan().toString() and df.count() > 3


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")


def test_grid_is_read_once(spark):
    """Conditions were made anew, with their join of predictions, for each side of each difference."""
    assert joins(own.QUERIES["grid_symmetric_diff"](spark, SF)) == 0
    keys = "a string, b int"
    want, seen = spark.createDataFrame([("x", 1), ("x", 2), (None, 1), ("y", 1), ("y", 1)], keys), spark.createDataFrame([("x", 2), (None, 1), (None, 2), ("x", 2)], keys)
    got = {tuple(r) for r in plans.grid_difference(want, seen, ["a", "b"]).collect()}
    assert got == {("x", 1, "missing"), ("y", 1, "missing"), (None, 2, "unexpected")}


def test_aligned_rules_share_conditions(spark):
    """Left to a rule are the predictions' own two joins."""
    assert joins(own.QUERIES["audit_aligned"](spark, SF)) <= 2


def test_model_reads_its_rows_once(spark):
    """Datasets, sizes and products each made the summary anew."""
    seen = F.udf(lambda x: total.add(1) or x, "double")
    total = spark.sparkContext.accumulator(0)
    rows = [(d, str(s), m, g, float(b), 0.1 * s + 0.01 * b + 0.03 * (s * b % 7)) for d in "AB" for s in range(4) for m in ("p", "q") for g in ("subject", "both") for b in (5, 10, 20)]
    df = spark.createDataFrame(rows, "dataset string, target_subject string, method string, regime string, budget double, v double").withColumn("log2_budget", F.log2(F.col("budget") + 1)).withColumn("v", seen("v"))
    assert mixed.terms(df, "v", ["p", "q"], ["subject", "both"], slopes=False).count() > 3
    assert total.value <= 2 * len(rows)  # the filter and the column each take the value; it was 4 times
