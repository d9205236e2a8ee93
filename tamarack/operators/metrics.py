"""Six binary metrics for each group, from windows and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def binary_metrics(p: DataFrame, keys: list[str], spread: bool = False) -> DataFrame:
    """roc_auc (average ranks), balanced_accuracy, accuracy, macro_f1, brier, log_loss by keys; null where a class is absent.

    Scores are first counted by value and class, so that the rank window sees distinct scores, not rows. With spread, these are sorted in ranges of keys and score, so that a
    condition's distinct scores need not fit a task: ranks run within a range, and the sums of the ranges before it are added to its sums, not to its rows.
    """
    y, s = F.col("y_true"), F.col("y_score")
    clipped = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), s))
    by = p.groupBy(*keys, "y_score").agg(
        F.count("*").alias("n"), F.sum("y_true").alias("pos"), F.sum((s - y) * (s - y)).alias("brier_"),
        F.sum(-(y * F.ln(clipped) + (1 - y) * F.ln(1 - clipped))).alias("loss_"),
    )
    if spread:
        by = by.repartitionByRange(*keys, "y_score").withColumn("range_", F.spark_partition_id())
    own = [*keys, "range_"] if spread else keys
    w = Window.partitionBy(*own).orderBy("y_score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by.withColumn("rank", F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / F.lit(2.0)).withColumn("hit", (F.col("y_score") >= 0.5).cast("long"))
    a = ranked.groupBy(*own).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("n1"), F.sum(F.col("rank") * F.col("pos")).alias("ranks"), F.sum(F.col("pos") * F.col("hit")).alias("tp"),
        F.sum((F.col("n") - F.col("pos")) * F.col("hit")).alias("fp"), F.sum("brier_").alias("brier_"), F.sum("loss_").alias("loss_"),
    )
    if spread:
        before = Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        a = a.withColumn("ranks", F.col("ranks") + F.coalesce(F.sum("n").over(before), F.lit(0)) * F.col("n1"))
        a = a.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "n1", "ranks", "tp", "fp", "brier_", "loss_")])
    a = a.withColumn("n0", F.col("n") - F.col("n1")).withColumn("fn", F.col("n1") - F.col("tp")).withColumn("tn", F.col("n0") - F.col("fp"))
    both = (F.col("n1") > 0) & (F.col("n0") > 0)
    ok = lambda e: F.when(both, e)
    f1 = lambda t, b, c: F.coalesce(F.try_divide(2.0 * F.col(t), 2.0 * F.col(t) + F.col(b) + F.col(c)), F.lit(0.0))
    return a.select(
        *keys, F.col("n").alias("n_trials"),
        ok((F.col("ranks") - F.col("n1") * (F.col("n1") + 1) / F.lit(2.0)) / (F.col("n1") * F.col("n0"))).alias("roc_auc"),
        ok((F.col("tp") / F.col("n1") + F.col("tn") / F.col("n0")) / 2).alias("balanced_accuracy"), ok((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"),
        ok((f1("tp", "fp", "fn") + f1("tn", "fn", "fp")) / 2).alias("macro_f1"), ok(F.col("brier_") / F.col("n")).alias("brier"), ok(F.col("loss_") / F.col("n")).alias("log_loss"),
    )
