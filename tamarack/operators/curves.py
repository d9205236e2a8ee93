"""Repeat averages, calibration curves, areas, slopes, thresholds and scopes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.sources import CONDITION, METRICS


#: What a metric table may say of a condition besides its metrics; averaged where it is there.
CONTEXT = ["calibration_trials_total", "source_subject_count", "source_trials", "train_trials", "test_trials", "fit_seconds", "predict_seconds"]


def successful(m: DataFrame) -> DataFrame:
    """The conditions that were fitted; a table without a status has no others."""
    return m.filter("status = 'ok'") if "status" in m.columns else m


def repeat_average(m: DataFrame) -> DataFrame:
    """Means over repeats, and how many repeats and different splits there were."""
    context = [c for c in CONTEXT if c in m.columns]
    splits = [F.countDistinct("split_id").alias("n_unique_test_splits")] if "split_id" in m.columns else []
    g = successful(m).groupBy(*CONDITION).agg(*[F.avg(c).alias(c) for c in METRICS + context], F.count("*").alias("n_repeats_observed"), *splits)
    return g.withColumn("log2_budget", F.log2(F.col("budget") + 1))


def curve_long(s: DataFrame) -> DataFrame:
    long = s.unpivot(["dataset", "method", "regime", "budget"], METRICS, "metric", "value").dropna(subset=["value"])
    return long.groupBy("dataset", "method", "regime", "budget", "metric").agg(F.avg("value").alias("mean"), F.count("*").alias("n"), F.stddev_samp("value").alias("sd"), F.median("value").alias("median"))


def aucc(s: DataFrame, metric: str, expected: list[int], horizon: int, threshold: float = 0.5) -> DataFrame:
    """Each participant's curve over budgets up to the horizon: completeness with reasons, normalised trapezoid area over log2(b + 1), slope,
    and the least budget that reaches the threshold; null unless complete. Of a subject's own regime, zero is no expected budget."""
    keys = ["dataset", "target_subject", "method", "regime"]
    inside = (F.col("budget") <= horizon) & F.col(metric).isNotNull()
    p = s.filter(F.col("regime").isin("subject", "source_plus_target")).withColumn("inside", inside)
    w = Window.partitionBy(*keys, "inside").orderBy("budget")
    x, y = F.log2(F.col("budget") + 1), F.when(F.col("inside"), F.col(metric))
    p = p.withColumn("x", F.when(F.col("inside"), x)).withColumn("part", F.when(F.col("inside"), (F.col("x") - F.lag("x").over(w)) * (y + F.lag(y).over(w)) / 2))
    g = p.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(F.col("inside"), F.col("budget")))).alias("seen"), F.sum("part").alias("area"), (F.max("x") - F.min("x")).alias("width"),
        F.regr_slope(y, F.col("x")).alias("slope"), F.min(F.when(y >= threshold, F.col("budget"))).alias("first_budget"),
    )
    own = lambda of: F.array(*[F.lit(b) for b in of]).cast("array<int>")
    want = F.when(F.col("regime") == "subject", own([b for b in expected if b])).otherwise(own(expected))
    text = lambda a: F.array_join(a.cast("array<string>"), ";")
    missing, extra = F.array_except(want, F.col("seen")), F.array_except(F.col("seen"), want)
    reason = F.concat_ws(" | ", F.when(F.size(missing) > 0, F.concat(F.lit("missing="), text(missing))), F.when(F.size(extra) > 0, F.concat(F.lit("unexpected="), text(extra))), F.when(F.size("seen") == 0, F.lit("no_points_within_horizon")))
    done = (F.size(missing) == 0) & (F.size(extra) == 0) & (F.size("seen") > 0)
    only = lambda c: F.when(done, c)
    return g.select(*keys, text(F.col("seen")).alias("observed_budgets"), done.alias("curve_complete"), reason.alias("reason"), only(F.try_divide("area", "width")).alias("aucc"), only(F.col("slope")).alias("slope"), only(F.col("first_budget")).alias("first_budget"))


def scoped(df: DataFrame, column: str = "dataset") -> DataFrame:
    """Each row under its own scope and, if there is more than one, under ALL."""
    many = df.agg(F.countDistinct(column) > 1).scalar()
    return df.withColumn("scope", F.explode(F.when(many, F.array(F.col(column), F.lit("ALL"))).otherwise(F.array(F.col(column)))))


def paired(s: DataFrame, column: str, left: str, right: str, keys: list[str], value: str) -> DataFrame:
    """keys and difference = right - left, for keys that have both."""
    wide = s.groupBy(*keys).pivot(column, [left, right]).agg(F.first(value))
    return wide.dropna(subset=[left, right]).select(*keys, (F.col(right) - F.col(left)).alias("difference"))


def benefit(d: DataFrame, keys: list[str]) -> DataFrame:
    x = F.col("difference")
    return d.groupBy(*keys).agg(F.count_if(x > 0).alias("n_positive"), F.count_if(x == 0).alias("n_zero"), F.count_if(x < 0).alias("n_negative"), F.count("*").alias("n_total"), F.avg((x > 0).cast("double")).alias("fraction"))


def signed_ranks(d: DataFrame, keys: list[str]) -> DataFrame:
    """n, W+, W-, statistic, rank-biserial correlation and the normal p-value with tie correction; zeros drop out, ties get mean ranks."""
    by = d.filter("difference <> 0").withColumn("a", F.abs("difference")).groupBy(*keys, "a").agg(F.count("*").alias("n"), F.count_if(F.col("difference") > 0).alias("up"))
    w = Window.partitionBy(*keys).orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    r = by.withColumn("rank", F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / F.lit(2.0))
    t = r.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("up"))).alias("w_minus"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    z2 = F.pow(F.least("w_plus", "w_minus") - F.col("n") * (F.col("n") + 1) / 4, F.lit(2)) / (F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("ties") / 48)
    return t.select(*keys, "n", "w_plus", "w_minus", F.least("w_plus", "w_minus").alias("statistic"), ((F.col("w_plus") - F.col("w_minus")) / (F.col("w_plus") + F.col("w_minus"))).alias("rank_biserial"), F.sqrt(z2).alias("abs_z"), "ties")


def holm(df: DataFrame, family: str, p: str, ties: list[str]) -> DataFrame:
    """p_holm within each family: step-down, running maximum, at most 1; null p stays null."""
    w = Window.partitionBy(family).orderBy(F.col(p).asc_nulls_last(), *ties)
    m = F.count(p).over(Window.partitionBy(family))
    step = F.when(F.col(p).isNotNull(), (m - F.row_number().over(w) + 1) * F.col(p))
    top = F.max("step_").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("step_", step).withColumn("p_holm", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), top))).drop("step_")


def hash_bootstrap(df: DataFrame, keys: list[str], value: str, order: str, resamples: int, seed: int) -> DataFrame:
    """Percentile interval of the mean over seeded resamples; draw (b, i) takes the value at md5 of (seed, b, i) mod n. A group's values are
    participants, which are few."""
    g = df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("v"))
    draw = lambda b, i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), b, i)), 1, 8), 16, 10).cast("long") % F.size("v")
    mean = lambda b: F.aggregate(F.sequence(F.lit(1), F.size("v")), F.lit(0.0), lambda a, i: a + F.get("v", draw(b, i).cast("int"))) / F.size("v")
    means = F.explode(F.transform(F.sequence(F.lit(1), F.lit(resamples)), mean))
    return g.select(*keys, means.alias("m")).groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high"))


#: Chances that a draw of n out of n takes a row at most so often, as n grows: steps of the Poisson distribution of mean 1. 32 bits do not reach further.
TIMES = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def resampled_means(df: DataFrame, keys: list[str], value: str, row_id: Column, resamples: int, seed: int) -> DataFrame:
    """keys, b (from 1), m: the mean of each of `resamples` seeded resamples of a group's finite values. How often a resample takes a row is drawn from its id alone, as is usual where no
    task holds a group: sums add up wherever the rows are. A digest of (seed, id, four resamples) gives four draws. A resample that takes no row has none."""
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))).select(*keys, F.col(value).cast("double").alias("v"), row_id.cast("string").alias("id"))
    four = rows.select(*keys, "v", "id", F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // 4))).alias("q"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "id", "q"))
    unit = lambda k: F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("double") / float(1 << 32)
    times = lambda u: sum(((u >= t).cast("int") for t in TIMES), F.lit(0))
    draws = F.array(*[F.struct((F.col("q") * 4 + k + 1).alias("b"), times(unit(k)).alias("n")) for k in range(4)])
    taken = four.withColumn("digest", digest).select(*keys, "v", F.inline(draws)).filter((F.col("n") > 0) & (F.col("b") <= resamples))
    return taken.groupBy(*keys, "b").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("m"))


def merged_bootstrap(df: DataFrame, keys: list[str], value: str, row_id: Column, resamples: int, seed: int, level: float = 0.95) -> DataFrame:
    """keys, ci_low, ci_high: percentile limits of resampled_means. Nothing is gathered by group but the resamples' means."""
    tail = (1 - level) / 2
    return resampled_means(df, keys, value, row_id, resamples, seed).groupBy(*keys).agg(F.percentile("m", F.lit(tail)).alias("ci_low"), F.percentile("m", F.lit(1 - tail)).alias("ci_high"))
