"""Integrity rules as constraint queries. Each gives the rows that break it; an audit is a table of their counts, run before
anything is built on the results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def unlike(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.exceptAll(right).unionByName(right.exceptAll(left))


#: Rows are summed up by so many leading bits of their hashes.
PREFIX = 12


def _signed(a: DataFrame, b: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows of both tables with all values as strings, and sign_: 1 of a, -1 of b."""
    names = sorted(a.columns)
    text = lambda d, sign: d.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names], F.lit(sign).alias("sign_"))
    return text(a, 1).unionByName(text(b, -1)), names


def unlike_prefixes(a: DataFrame, b: DataFrame) -> DataFrame:
    """prefix_: the leading bits of row hashes under which the tables differ as bags; there are 2^PREFIX at most. Hashes of 128 bits are summed in four parts, which
    needs no order and adds up before anything is shuffled. Unlike bags of equal sums would need rows made for it."""
    rows, names = _signed(a, b)
    each = [x for c in names for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    rows = rows.select("sign_", F.xxhash64(*each).alias("x"), F.xxhash64(F.lit(1), *each).alias("y"))
    half = (1 << 32) - 1
    parts = [F.sum(F.col("sign_") * p) for c in "xy" for p in (F.col(c).bitwiseAND(half), F.shiftrightunsigned(c, 32))]
    sums = rows.groupBy(F.shiftrightunsigned("x", 64 - PREFIX).alias("prefix_")).agg(F.sum("sign_").alias("n"), *[p.alias(f"s{k}") for k, p in enumerate(parts)])
    return sums.filter(reduce(lambda p, q: p | q, [F.col(c) != 0 for c in ("n", "s0", "s1", "s2", "s3")])).select("prefix_")


def unequal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, as strings, that one table has more often than the other, as often as it has more. Only rows under unlike prefixes are held against one another: of
    equal tables, none."""
    rows, names = _signed(a, b)
    each = [x for c in names for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    bad = F.broadcast(unlike_prefixes(a, b))  # 2^PREFIX rows at most
    left = rows.withColumn("prefix_", F.shiftrightunsigned(F.xxhash64(*each), 64 - PREFIX)).join(bad, "prefix_", "left_semi")
    more = left.groupBy(*[f"`{c}`" for c in names]).agg(F.sum("sign_").alias("more_")).filter("more_ <> 0")
    return more.select(*[f"`{c}`" for c in names], F.explode(F.sequence(F.lit(1), F.abs("more_").cast("int"))).alias("copy_")).drop("copy_")


def audit(rules: dict[str, DataFrame]) -> DataFrame:
    """rule, n_violations; in one plan."""
    parts = [df.agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("rule"), "n_violations") for name, df in rules.items()]
    return reduce(DataFrame.unionByName, parts)


def gate(report: DataFrame) -> None:
    """Raises if any rule is broken."""
    broken = report.filter("n_violations > 0").collect()  # a row for each rule
    if broken:
        raise ValueError("audit failed: " + ", ".join(f"{r.rule}: {r.n_violations}" for r in broken))


def status(report: DataFrame) -> DataFrame:
    """One row: ok where no rule is broken; else failed, with the broken rules and their counts."""
    broken = F.array_sort(F.collect_list(F.when(F.col("n_violations") > 0, F.concat_ws(": ", "rule", F.col("n_violations").cast("string")))))
    said = F.array_join("broken", ", ")
    return report.agg(broken.alias("broken")).select(F.when(F.size("broken") == 0, "ok").otherwise("failed").alias("status"), F.when(F.size("broken") > 0, F.lit("ValueError")).alias("error_type"), F.when(F.size("broken") > 0, said).alias("error_message"))


def examples(rules: dict[str, DataFrame], most: int = 10) -> DataFrame:
    """rule, example: some rows that break each rule, as JSON, the first ones of its order."""
    parts = [df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("example")).orderBy("example").limit(most).select(F.lit(name).alias("rule"), "example") for name, df in rules.items()]
    return reduce(DataFrame.unionByName, parts)


def ordered(df: DataFrame, *columns: str) -> DataFrame:
    """Sorted by these columns, nulls last."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def assignment_rules(split: DataFrame, sample: DataFrame) -> dict[str, DataFrame]:
    key = ["dataset", "subject", "trial_uid"]
    roles = split.groupBy("dataset", "subject").agg(F.countDistinct("role").alias("n")).filter("n <> 2")
    groups = split.groupBy("dataset", "subject", "session").agg(F.countDistinct("role").alias("n")).filter("n <> 1")
    counts = sample.groupBy("dataset", "subject", "budget", "label").count().filter("count <> budget")
    outside = sample.join(split.filter("role = 'calibration_pool'"), key, "left_anti")
    smaller = sample.select(*key, F.col("budget").alias("small")).join(sample.groupBy("dataset", "subject").agg(F.max("budget").alias("top")), ["dataset", "subject"])
    broken = smaller.filter("small < top").join(sample.select(*key, F.col("budget").alias("top")), [*key, "top"], "left_anti")
    return {"two_roles": roles, "session_in_one_role": groups, "class_counts": counts, "sample_in_pool": outside, "samples_nest": broken, "unique_trials": duplicates(split, key)}


def metric_rules(m: DataFrame, keys: list[str], metrics: list[str]) -> dict[str, DataFrame]:
    """A metric table's own rules: unique keys, known regimes at fitting budgets, complete metrics in range."""
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) for c in metrics])
    return {
        "unique_conditions": duplicates(m, keys), "known_regime": m.filter(~F.col("regime").isin("population", "subject", "source_plus_target")),
        "population_at_zero": m.filter("regime = 'population' and budget <> 0"), "subject_above_zero": m.filter("regime = 'subject' and budget <= 0"),
        "metrics_complete": m.filter(null), "auc_in_range": m.filter("roc_auc < 0 or roc_auc > 1"),
    }


def miscounted(m: DataFrame, p: DataFrame, keys: list[str]) -> DataFrame:
    """Conditions whose stated number of trials is not that of their predictions; either side may lack the condition."""
    found = p.groupBy(*keys).agg(F.count("*").alias("n_found"))
    return m.select(*keys, "n_trials").join(found, keys, "full_outer").filter(~F.col("n_trials").eqNullSafe(F.col("n_found")))


def recomputed(stored: DataFrame, again: DataFrame, keys: list[str], metrics: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Keys at which a stored metric is not the recomputed one, within an absolute and relative tolerance."""
    both = stored.select(*keys, F.lit(1).alias("in_a"), *[F.col(c).alias(f"a_{c}") for c in metrics]).join(again.select(*keys, F.lit(1).alias("in_b"), *[F.col(c).alias(f"b_{c}") for c in metrics]), keys, "full_outer")
    off = [~F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= tolerance + tolerance * F.abs(F.col(f"b_{c}")), F.col(f"a_{c}").isNull() & F.col(f"b_{c}").isNull()) for c in metrics]
    return both.filter(reduce(lambda a, b: a | b, off, F.col("in_a").isNull() | F.col("in_b").isNull())).select(*keys)


def worst(stored: DataFrame, again: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """metric, keys, difference: where each stored metric is furthest from the recomputed one."""
    long = lambda d, name: d.unpivot(keys, metrics, "metric", name)
    both = long(stored, "a").join(long(again, "b"), [*keys, "metric"]).withColumn("difference", F.abs(F.col("a") - F.col("b"))).dropna(subset=["difference"])
    best = both.groupBy("metric").agg(F.max(F.struct("difference", *keys)).alias("w"))
    return best.select("metric", *[F.col(f"w.{k}").alias(k) for k in keys], F.col("w.difference").alias("difference"))


def unlike_scores(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions that two sides don't share exactly."""
    both = a.select(*keys, F.col("y_score").alias("left_")).join(b.select(*keys, F.col("y_score").alias("right_")), keys, "full_outer")
    return both.filter(~F.col("left_").eqNullSafe(F.col("right_"))).drop("left_", "right_")


def prediction_rules(p: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    return {
        "score_in_range": p.filter("y_score is null or isnan(y_score) or y_score < 0 or y_score > 1"), "prediction_is_threshold": p.filter("y_pred <> cast(y_score >= 0.5 as int)"),
        "binary_label": p.filter("y_true is null or y_true not in (0, 1)"), "both_labels": p.groupBy(*keys).agg(F.countDistinct("y_true").alias("n")).filter("n <> 2"),
    }


def source_rules(chosen: DataFrame, sampled: DataFrame, most: int, cap: int) -> dict[str, DataFrame]:
    """chosen: dataset, target_subject, source_subject; sampled: dataset, subject, label of the trials taken from each source."""
    per = sampled.groupBy("dataset", "subject").agg(F.count_if(F.col("label") == 0).alias("c0"), F.count_if(F.col("label") == 1).alias("c1"))
    return {
        "target_is_no_source": chosen.filter("target_subject = source_subject"), "source_cap": chosen.groupBy("dataset", "target_subject").count().filter(F.col("count") > most),
        "trial_cap": per.filter(F.greatest("c0", "c1") > cap), "balanced": per.filter("c0 <> c1"),
    }


def grid_difference(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Conditions that are missing or unexpected; null keys equal one another. Either table is read once."""
    both = expected.select(*keys, F.lit(True).alias("expected_")).unionByName(observed.select(*keys, F.lit(False).alias("expected_")))
    one = both.groupBy(*keys).agg(F.min("expected_").alias("low_"), F.max("expected_").alias("high_")).filter("low_ = high_")
    return one.select(*keys, F.when(F.col("low_"), "missing").otherwise("unexpected").alias("side"))


def structure(t: DataFrame, sessions: int, runs: int, per_class: int) -> DataFrame:
    """A row for each subject: sessions, most runs of a session, fewest trials of a class in a session, and whether they are as expected."""
    cells = t.groupBy("dataset", "subject", "session").agg(F.countDistinct("run").alias("runs"), F.count_if(F.col("label") == 0).alias("c0"), F.count_if(F.col("label") == 1).alias("c1"))
    g = cells.groupBy("dataset", "subject").agg(F.count("*").alias("n_sessions"), F.max("runs").alias("n_runs"), F.min(F.least("c0", "c1")).alias("least_of_class"))
    return g.withColumn("as_expected", (F.col("n_sessions") == sessions) & (F.col("n_runs") == runs) & (F.col("least_of_class") >= per_class))


def protocol_rules(m: DataFrame) -> dict[str, DataFrame]:
    """Of stored metrics: one split for all methods and regimes of a repeat; marked as a copy exactly if pooled without calibration."""
    one = m.groupBy("dataset", "target_subject", "repeat").agg(F.countDistinct("split_id").alias("n")).filter("n <> 1")
    copy = (F.col("regime") == "source_plus_target") & (F.col("budget_per_class") == 0)
    return {"shared_split": one, "copy_flag": m.filter(~F.col("duplicate_of_population").eqNullSafe(copy))}


def detail_rules(selection: DataFrame, detail: DataFrame, most: int | None, cap: int | None, balance: bool) -> dict[str, DataFrame]:
    """Of stored source tables: trials are unique and binary, none is the target's; each source's row is what its trials sum up to; caps and balance hold."""
    keys = ["dataset", "target_subject", "source_subject"]
    rolled = detail.groupBy(*keys).agg(
        F.min("selection_seed").alias("seed"), F.countDistinct("selection_seed").alias("seeds"), F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("c0"), F.count_if(F.col("label") == 1).alias("c1"),
        F.sha2(F.to_json(F.array_sort(F.collect_list("trial_uid"))), 256).alias("digest"),
    )
    both = selection.withColumn("in_selection", F.lit(1)).join(rolled, keys, "full_outer")
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("selection_seed", "seed"), ("selected_trials", "n"), ("class_0_trials", "c0"), ("class_1_trials", "c1"), ("selected_trial_uid_sha256", "digest"))]
    top = 2**31 - 1
    return {
        "unique_sources": duplicates(selection, keys), "unique_source_trials": duplicates(detail, [*keys, "trial_uid"]), "target_is_no_source": selection.select(*keys).unionByName(detail.select(*keys)).filter("target_subject = source_subject"),
        "binary_source_label": detail.filter("label is null or label not in (0, 1)"), "one_seed": rolled.filter("seeds <> 1"), "source_rollup": both.filter(~reduce(lambda a, b: a & b, same)),
        "source_cap": selection.groupBy("dataset", "target_subject").agg(F.countDistinct("source_subject").alias("n")).filter(F.col("n") > (most or top)),
        "trial_cap": selection.filter(F.greatest("class_0_trials", "class_1_trials") > (cap or top)), "balanced": selection.filter("class_0_trials <> class_1_trials" if balance else "false"),
    }


def stored_assignment_rules(split: DataFrame, calibration: DataFrame, budgets: list[int]) -> dict[str, DataFrame]:
    """Of stored splits and samples, by repeat: unique trials, two roles, groups in one role; each sample's classes, membership in its pool, and
    nesting in the next larger one; every positive budget is there."""
    key = ["dataset", "target_subject", "repeat", "split_id"]
    at = [*key, "trial_uid"]
    want = F.array(*[F.lit(b) for b in sorted(budgets) if b]).cast("array<int>")
    step = calibration.select(*at, F.col("budget_per_class").alias("small")).join(calibration.groupBy(*key).agg(F.array_sort(F.collect_set("budget_per_class")).alias("all")), key)
    step = step.withColumn("budget_per_class", F.get(F.filter("all", lambda b: b > F.col("small")), F.lit(0))).filter("budget_per_class is not null")
    return {
        "unique_split_trials": duplicates(split, at), "unique_sample_trials": duplicates(calibration, [*at, "budget_per_class"]), "two_roles": split.groupBy(*key).agg(F.countDistinct("role").alias("n")).filter("n <> 2"),
        "known_role": split.filter("role is null or role not in ('calibration_pool', 'test')"), "group_in_one_role": split.groupBy(*key, "group_id").agg(F.countDistinct("role").alias("n")).filter("n <> 1"),
        "one_split_a_repeat": split.groupBy(*key[:3]).agg(F.countDistinct("split_id").alias("n")).filter("n <> 1"), "class_counts": calibration.groupBy(*key, "budget_per_class", "label").count().filter("count <> budget_per_class"),
        "sample_in_pool": calibration.join(split.filter("role = 'calibration_pool'"), at, "left_anti"), "samples_nest": step.join(calibration, [*at, "budget_per_class"], "left_anti"),
        "every_budget": split.select(*key).distinct().join(calibration.groupBy(*key).agg(F.array_sort(F.collect_set("budget_per_class")).alias("seen")), key, "left").filter(~F.col("seen").eqNullSafe(want) & (F.size(want) > 0)),
    }


def aligned_rules(m: DataFrame, p: DataFrame, source: DataFrame, target: DataFrame, mode: str, expected: int) -> dict[str, DataFrame]:
    """Of an aligned run: no population and no zero budget anywhere, one mode; unique predictions and provenance; one digest of the alignment's
    settings; as many conditions as expected."""
    keys, at = ["dataset", "target_subject", "repeat", "method", "regime", "budget_per_class", "split_id"], ["dataset", "target_subject", "repeat", "split_id", "budget_per_class"]
    digests = source.select("alignment_config_digest").unionByName(target.select("alignment_config_digest")).distinct()
    return {
        "aligned_regime": m.filter("regime is null or regime not in ('subject', 'source_plus_target')"), "positive_budget": m.select("budget_per_class").unionByName(p.select("budget_per_class")).unionByName(target.select("budget_per_class")).filter("budget_per_class <= 0"),
        "alignment_mode": m.select("alignment_mode").unionByName(p.select("alignment_mode")).filter(~F.col("alignment_mode").eqNullSafe(F.lit(mode))), "unique_predictions": duplicates(p, [*keys, "trial_uid"]),
        "unique_conditions": duplicates(m, keys), "unique_source_alignment": duplicates(source, ["dataset", "target_subject", "source_subject"]), "target_is_no_source": source.filter("target_subject = source_subject"),
        "unique_target_alignment": duplicates(target, at), "one_alignment_config": digests.agg(F.count("*").alias("n")).filter("n <> 1"), "aligned_split": m.groupBy(*at[:3]).agg(F.countDistinct("split_id").alias("n")).filter("n <> 1"),
        "expected_conditions": m.select(*keys).distinct().agg(F.count("*").alias("n")).filter(F.col("n") != expected),
    }


def unlike_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two runs' metric tables has and the other has not, timings aside."""
    timed = ("fit_seconds", "predict_seconds")
    return unequal(a.drop(*timed), b.drop(*timed))
