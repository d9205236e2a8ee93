"""Queries of reused assignments, stored rules, aligned runs and publication tables, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack import benchmark, plans, sources
from tamarack.kernel_queries import epoch_trials
from tamarack.operators import assign, bootstrap, curves, report, reuse, statistics
from tamarack.queries import BUDGETS, CELLS, K, ORACLES, PAIR, REPEAT, SAMPLE, SEED, SUMMARY, TRIALS, conditions, differences, pool, query, rounded, sample, summary
from tamarack.sources import shards

#: What contrasts need of a configuration.
SETTINGS = {"experiment": {"seed": SEED}, "metrics": {"primary": "roc_auc"}, "analysis": {"bootstrap_resamples": 200, "ci_level": 0.95, "pairwise_budgets": [5, 10]}}
end = lambda c: F.substring(c, -1, 1)
PAIRS = """b AS (SELECT DISTINCT dataset, subject FROM t), pr AS (SELECT x.dataset, x.subject AS target_subject, y.subject AS source_subject, row_number() OVER (PARTITION BY x.dataset, x.subject ORDER BY md5('%d:' || x.subject || ':' || y.subject), y.subject) AS place
 FROM b x JOIN b y ON x.dataset = y.dataset AND x.subject <> y.subject QUALIFY place <= 10)""" % SEED
TAKEN = f"""tc AS (SELECT *, least(count(*) FILTER (label = 0) OVER (PARTITION BY dataset, subject), count(*) FILTER (label = 1) OVER (PARTITION BY dataset, subject), 20) AS most,
 row_number() OVER (PARTITION BY dataset, subject, label ORDER BY md5('{SEED}:' || trial_uid), trial_uid) AS place FROM t), tk AS (SELECT * FROM tc WHERE place <= most)"""


def targets(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("subject", "target_subject")


@query(f"""WITH {SAMPLE}, {PAIRS}, {TAKEN} SELECT 'split' AS "table", count(*) FILTER (right(trial_uid, 1) <> '7') AS n_reused, count(*) AS n_again, count(*) FILTER (right(trial_uid, 1) = '7') AS n_differing FROM s
UNION ALL SELECT 'calibration', count(*), count(*), 2 * count(*) FILTER (budget = 1) FROM n UNION ALL SELECT 'sources', count(*), count(*), 2 * count(*) FILTER (place = 10) FROM pr
UNION ALL SELECT 'source_trials', count(*) FILTER (session <> 0), count(*), count(*) FILTER (session = 0) FROM tk""")
def assignment_reuse_gate(spark, d):
    """Tampered assignments against fresh ones: trials in 7 lack, labels of budget 1 are swapped, last sources are misplaced, a session's trials lack."""
    t = sources.trials(spark, d)
    again = {"split": assign.latest_session(t), "calibration": sample(spark, d), "sources": sources.kept(assign.sources(t, 10, SEED)), "source_trials": assign.balanced(t, 20, SEED)}
    bad = {
        "split": again["split"].filter(end("trial_uid") != "7"), "calibration": again["calibration"].withColumn("label", F.when(F.col("budget") == 1, 1 - F.col("label")).otherwise(F.col("label"))),
        "sources": again["sources"].withColumn("place", F.when(F.col("place") == 10, 11).otherwise(F.col("place"))), "source_trials": again["source_trials"].filter("session <> 0"),
    }
    return reuse.differences(bad, again)


@query(f"""WITH {SAMPLE}, o AS (SELECT dataset, subject, trial_uid, row_number() OVER (PARTITION BY dataset, subject ORDER BY session, run, trial_uid) - 1 AS position FROM t)
SELECT dataset, subject AS target_subject, budget, count(*) AS n, CAST(min(position) AS INTEGER) AS low, CAST(max(position) AS INTEGER) AS high, CAST(sum(position) AS BIGINT) AS total FROM n JOIN o USING (dataset, subject, trial_uid) GROUP BY ALL""")
def assignment_positions(spark, d):
    """Where the trials of reused samples lie among their subject's."""
    p = reuse.placed(targets(sample(spark, d)), sources.trials(spark, d))
    return p.groupBy("dataset", "target_subject", "budget").agg(F.count("*").alias("n"), F.min("position").alias("low"), F.max("position").alias("high"), F.sum("position").alias("total"))


@query(f"WITH {SAMPLE} SELECT dataset, subject AS target_subject, count(*) AS n FROM n WHERE right(trial_uid, 1) = '9' GROUP BY ALL")
def assignment_unknown_uids(spark, d):
    """Assigned trials that a table without those in 9 has not."""
    t = sources.trials(spark, d).filter(end("trial_uid") != "9")
    return reuse.unknown(targets(sample(spark, d)), t).groupBy("dataset", "target_subject").agg(F.count("*").alias("n"))


def stored_sources(spark, d) -> tuple[DataFrame, DataFrame]:
    """Selection and trials of sources as they are stored."""
    t = sources.trials(spark, d)
    taken = assign.balanced(t, 20, SEED)
    pairs = sources.kept(assign.sources(t, 10, SEED)).drop("place").withColumn("selection_seed", F.lit(SEED).cast("long"))  # every rule reads them
    own = assign.digests(taken).select("dataset", F.col("subject").alias("source_subject"), F.col("n").alias("selected_trials"), F.col("class_0").alias("class_0_trials"), F.col("class_1").alias("class_1_trials"), F.col("digest").alias("selected_trial_uid_sha256"))
    keys = ["dataset", "source_subject"]
    return pairs.join(own, keys), pairs.join(taken.withColumnRenamed("subject", "source_subject"), keys)


@query(f"""WITH {SAMPLE}, {PAIRS}, {TAKEN}, k AS (SELECT dataset, subject AS source_subject, count(*) FILTER (label = 0) AS c0, count(*) FILTER (label = 1) AS c1, count(*) FILTER (right(trial_uid, 1) = '1') AS e1, count(*) FILTER (right(trial_uid, 1) = '2') AS e2 FROM tk GROUP BY ALL),
 g AS (SELECT *, right(source_subject, 1) AS e FROM pr JOIN k USING (dataset, source_subject))
SELECT 'source_rollup' AS rule, count(*) FILTER (e IN ('3', '5') OR (e = '6' AND e1 > 0) OR (e = '9' AND e2 > 0)) AS n_violations FROM g UNION ALL SELECT 'unique_source_trials', coalesce(sum(e2) FILTER (e = '9'), 0)::BIGINT FROM g
UNION ALL SELECT 'source_cap', count(*) FROM (SELECT 1 FROM g GROUP BY dataset, target_subject HAVING count(DISTINCT source_subject) > 9) UNION ALL SELECT 'trial_cap', count(*) FILTER (greatest(c0 + CAST(e = '5' AS INTEGER), c1) > 12) FROM g
UNION ALL SELECT 'balanced', count(*) FILTER (e = '5') FROM g""")
def source_detail_rules(spark, d):
    """Rows of sources against their trials: of sources in 3 and 5 the row is wrong, of those in 6 trials lack, of those in 9 trials come twice."""
    selection, detail = stored_sources(spark, d)
    s, u = end("source_subject"), end("trial_uid")
    selection = selection.withColumns({"selected_trials": F.col("selected_trials") + (s == "3").cast("int"), "class_0_trials": F.col("class_0_trials") + (s == "5").cast("int")})
    twice = detail.filter((s == "9") & (u == "2"))
    detail = detail.filter(~((s == "6") & (u == "1"))).unionByName(twice)
    rules = plans.detail_rules(selection, detail, 9, 12, True)
    return plans.audit({k: rules[k] for k in ("source_rollup", "unique_source_trials", "source_cap", "trial_cap", "balanced")})


@query(f"""WITH {CELLS}, u AS (SELECT count(*) AS n FROM p WHERE regime <> 'population' AND method = 'csp_lda' AND repeat = 1)
SELECT 'aligned_regime' AS rule, count(*) FILTER (regime = 'population') AS n_violations FROM m UNION ALL SELECT 'positive_budget', (SELECT count(*) FROM m WHERE budget = 0) + (SELECT count(*) FROM p WHERE budget = 0 AND regime <> 'population') + (SELECT count(*) FROM (SELECT DISTINCT dataset, target_subject, repeat FROM m WHERE budget = 0))
UNION ALL SELECT 'alignment_mode', (SELECT count(*) FROM m WHERE method = 'riemann_lr') + (SELECT count(*) FROM p WHERE method = 'riemann_lr' AND regime <> 'population') UNION ALL SELECT 'one_alignment_config', 1
UNION ALL SELECT 'aligned_split', count(*) FROM (SELECT 1 FROM m WHERE repeat = 2 GROUP BY dataset, target_subject HAVING count(DISTINCT method = 'csp_lda') = 2) UNION ALL SELECT 'expected_conditions', CAST((SELECT count(*) FROM m) <> 100 AS BIGINT)
UNION ALL SELECT 'target_is_no_source', count(DISTINCT (dataset, target_subject)) FILTER (target_subject LIKE '%7') FROM m""")
def audit_aligned(spark, d):
    """An aligned run's rules over tables that break them: population rows and zero budgets, one method of another mode and, in one repeat, another split, two
    settings' digests, targets in 7 among their sources, and 100 conditions expected."""
    mode = F.when(F.col("method") == "riemann_lr", "none").otherwise(benchmark.ALIGNED)
    split = F.when((F.col("repeat") == 2) & (F.col("method") == "csp_lda"), "b").otherwise("a")
    own = lambda df: df.withColumnRenamed("budget", "budget_per_class").withColumns({"alignment_mode": mode, "split_id": split})
    m, p = own(sources.kept(conditions(spark, d).select(*REPEAT))), own(sources.predictions(spark, d).filter("regime <> 'population'"))  # most rules read the conditions, of which these need the keys
    people = m.select("dataset", "target_subject").distinct()
    source = people.withColumn("source_subject", F.when(end("target_subject") == "7", F.col("target_subject")).otherwise("x")).withColumn("alignment_config_digest", F.lit("one"))
    target = m.select("dataset", "target_subject", "repeat", F.lit("a").alias("split_id"), "budget_per_class").distinct().withColumn("alignment_config_digest", F.lit("two"))
    rules = plans.aligned_rules(m, p, source, target, benchmark.ALIGNED, 100)
    return plans.audit({k: rules[k] for k in ("aligned_regime", "positive_budget", "alignment_mode", "one_alignment_config", "aligned_split", "expected_conditions", "target_is_no_source")})


@query(f"""WITH {PAIR} SELECT method, budget, scope, CASE scope WHEN 'ALL' THEN 'aligned_regime_exploratory' ELSE 'aligned_regime_dataset_descriptive' END AS family, 'exploratory' AS inference_role, '{benchmark.EXPLORATORY}' AS classification, count(*) AS n_pairs FROM sc WHERE budget IN (5, 10) GROUP BY ALL""")
def aligned_relabel(spark, d):
    """Tests of an aligned run: no family is called confirmatory."""
    t = statistics.relabelled(statistics.regime_family(summary(spark, d), [5, 10], "roc_auc"), statistics.ALIGNED, "exploratory", benchmark.EXPLORATORY)
    return t.select("method", "budget", "scope", "family", "inference_role", "classification", "n_pairs")


@query(f"""WITH {PAIR} SELECT method, budget, dataset AS scope, count(*) AS n_pairs, round(avg(difference), 6) + 0.0::DOUBLE AS mean, round(median(difference), 6) + 0.0::DOUBLE AS median, 'regime_without_dataset_supportive' AS family, 'robustness_check_dataset_supportive' AS inference_role
FROM d WHERE dataset <> 'O' AND budget IN (5, 10) GROUP BY ALL""")
def without_dataset_tests(spark, d):
    """Tests without a dataset of which 20 participants must be left."""
    t = statistics.regime_family(statistics.without(summary(spark, d), "O", 20), [5, 10], "roc_auc")
    return rounded(statistics.relabelled(t, statistics.WITHOUT, statistics.WITHOUT_ROLES, "").select("method", "budget", "scope", "n_pairs", "mean", "median", "family", "inference_role"))


def tests(spark, d) -> DataFrame:
    s = summary(spark, d)
    return statistics.contrasts(s, curves.aucc(s, "roc_auc", [5, 10, 20], 20), SETTINGS, ci=False)


VALUES = "n_pairs, mean, p, p_holm, rank_biserial"
R, M = (f"SELECT * FROM ({ORACLES[k]})" for k in ("regime_tests", "method_tests"))


@query(f"""SELECT family, 'source_plus_target - subject' AS contrast, budget || ' trials/class' AS budget_or_regime, CAST(budget AS INTEGER) AS budget, NULL::VARCHAR AS regime, method AS method_display, {VALUES} FROM ({R}) WHERE scope = 'ALL'
UNION ALL SELECT family, 'riemann_lr - csp_lda', regime || ' regime (AUCC)', NULL, regime, 'riemann_lr vs csp_lda', {VALUES} FROM ({M}) WHERE scope = 'ALL' AND regime = 'subject'""")
def table_main_contrasts(spark, d):
    return rounded(report.main_contrasts(tests(spark, d)).drop("ci_lower", "ci_upper"))


@query(f"""SELECT family, scope AS scope_dataset, 'source_plus_target - subject' AS contrast, budget || ' trials/class' AS budget_or_regime, method AS method_display, {VALUES} FROM ({R}) WHERE scope <> 'ALL'
UNION ALL SELECT family, scope, 'riemann_lr - csp_lda', regime || ' regime (AUCC)', 'riemann_lr vs csp_lda', {VALUES} FROM ({M}) WHERE scope <> 'ALL'""")
def table_supportive_contrasts(spark, d):
    return rounded(report.supportive_contrasts(tests(spark, d)).drop("ci_lower", "ci_upper"))


@query(f"""SELECT dataset, method, regime, budget, metric, mean, n, round(log2(budget + 1), 6) AS x, CASE regime WHEN 'subject' THEN 'A' ELSE 'B' END AS figure_panel FROM ({ORACLES["curve_long_stats"]}) WHERE dataset = 'F' AND metric = 'roc_auc' AND regime <> 'population'""")
def small_cohort_curves(spark, d):
    return rounded(report.small_cohort(curves.curve_long(summary(spark, d)), "F").select("dataset", "method", "regime", "budget", "metric", "mean", "n", "x", "figure_panel"))


@query(f"""SELECT method, budget, ci_low > 0 OR ci_high < 0 AS excludes_zero FROM ({ORACLES["bootstrap_hash_ci"]})""")
def ci_excludes_zero(spark, d):
    x = differences(spark, d).withColumn("id", F.concat_ws("::", "dataset", "target_subject"))
    ci = rounded(curves.hash_bootstrap(x, ["method", "budget"], "difference", "id", 2000, SEED))
    return ci.select("method", "budget", statistics.excludes_zero(F.col("ci_low"), F.col("ci_high")).alias("excludes_zero"))


@query(f"""WITH {CELLS} SELECT 'shared_split' AS rule, count(*) AS n_violations FROM (SELECT 1 FROM m WHERE repeat = 2 GROUP BY dataset, target_subject HAVING count(DISTINCT method = 'csp_lda') = 2)
UNION ALL SELECT 'copy_flag', count(*) FILTER (regime = 'population') FROM m""")
def audit_protocol(spark, d):
    """One method has another split in one repeat; population rows are marked as copies."""
    m = conditions(spark, d).withColumnRenamed("budget", "budget_per_class")
    return plans.audit(plans.protocol_rules(m.withColumns({"split_id": F.when((F.col("repeat") == 2) & (F.col("method") == "csp_lda"), "b").otherwise("a"), "duplicate_of_population": F.col("regime") == "population"})))


@query(f"""WITH {SUMMARY}, x AS (SELECT *, CASE WHEN roc_auc IS NULL OR repeat = 2 THEN 'failed' ELSE 'ok' END AS status FROM m), y AS (SELECT dataset, count(*) AS k FROM (SELECT DISTINCT dataset, target_subject, method, regime, budget FROM x WHERE status = 'ok') GROUP BY ALL)
SELECT dataset, count(DISTINCT target_subject) AS participants_attempted, count(DISTINCT target_subject) FILTER (status = 'ok') AS participants_with_any_success, count(DISTINCT target_subject) FILTER (status <> 'ok') AS participants_with_any_failure,
 count(*) FILTER (status = 'ok') AS successful_condition_rows, count(*) FILTER (status <> 'ok') AS failed_condition_rows, any_value(k) AS participant_condition_summaries FROM x JOIN y USING (dataset) GROUP BY dataset""")
def participant_flow_of_status(spark, d):
    """Failed conditions stay in the metrics and out of the summaries."""
    m = conditions(spark, d).withColumn("status", F.when(F.col("roc_auc").isNull() | (F.col("repeat") == 2), "failed").otherwise("ok")).withColumn("split_id", F.lit("a"))
    return benchmark.flow(m, curves.repeat_average(m))


@query(f"WITH {CELLS} SELECT method, 2 * count(*) AS n FROM m WHERE repeat = 2 AND accuracy IS NOT NULL GROUP BY ALL")
def unlike_runs(spark, d):
    """Two runs that differ in timings everywhere, and in the accuracy of one repeat."""
    m = conditions(spark, d).withColumn("fit_seconds", F.col("n_trials") / 100)
    other = m.withColumns({"fit_seconds": F.col("n_trials") / 50, "accuracy": F.when(F.col("repeat") == 2, F.col("accuracy") + 1).otherwise(F.col("accuracy"))})
    return plans.unlike_runs(m, other).groupBy("method").agg(F.count("*").alias("n"))


@query(f"""WITH {SUMMARY} SELECT dataset, target_subject, method, regime, budget, CAST(row_number() OVER (PARTITION BY dataset, method ORDER BY round(roc_auc, 6) NULLS LAST, regime, budget, target_subject) AS INTEGER) AS place FROM a""")
def ordered_summary(spark, d):
    """Rows in order of a metric, those without it last."""
    line = Window.partitionBy("dataset", "method").orderBy(F.col("roc_auc").asc_nulls_last(), "regime", "budget", "target_subject")
    return rounded(summary(spark, d)).select("dataset", "target_subject", "method", "regime", "budget", F.row_number().over(line).alias("place"))


@query(f"""WITH {CELLS} SELECT 'metrics_complete' AS rule, example FROM (SELECT '{{"dataset":"' || dataset || '","target_subject":"' || target_subject || '","repeat":' || repeat || ',"method":"' || method || '","regime":"' || regime || '","budget":' || budget || '}}' AS example FROM m WHERE roc_auc IS NULL OR repeat = 1 ORDER BY example LIMIT 10)""")
def audit_examples(spark, d):
    """The first ten conditions that lack a metric; of one repeat all do."""
    m = conditions(spark, d).withColumn("brier", F.when(F.col("repeat") != 1, F.col("brier"))).select(*REPEAT, *sources.METRICS)
    bad = plans.metric_rules(m, REPEAT, sources.METRICS)["metrics_complete"].select("dataset", "target_subject", "repeat", "method", "regime", "budget")
    return plans.examples({"metrics_complete": bad})


@query(f"WITH {CELLS} SELECT 'roc_auc' AS metric, {K}, n_trials::DOUBLE AS difference FROM m ORDER BY n_trials DESC, dataset DESC, target_subject DESC, repeat DESC, method DESC, regime DESC, budget DESC LIMIT 1")
def worst_recompute(spark, d):
    """Where a stored metric of 0 is furthest from a recomputed one, here the number of trials."""
    m = conditions(spark, d)
    keys = ["dataset", "target_subject", "repeat", "method", "regime", "budget"]
    return plans.worst(m.withColumn("roc_auc", F.lit(0.0)), m.withColumn("roc_auc", F.col("n_trials").cast("double")), keys, ["roc_auc"])


E = "e AS (SELECT vec_id, CAST(vec_id % 10 AS VARCHAR) AS subject, (vec_id // 10) % 3 AS session, CAST(label % 2 AS INTEGER) AS label FROM embeddings)"


@query(f"""WITH {E}, c AS (SELECT subject, string_agg(label || '=' || n, ';' ORDER BY label) AS class_counts FROM (SELECT subject, label, count(*) AS n FROM e GROUP BY ALL) GROUP BY subject), g AS (SELECT subject, string_agg(session || '::0=' || n, ';' ORDER BY session) AS group_counts FROM (SELECT subject, session, count(*) AS n FROM e GROUP BY ALL) GROUP BY subject)
SELECT 'E' AS dataset, subject, count(*) AS trials, 4 AS channels, 16 AS samples, any_value(class_counts) AS class_counts, any_value(group_counts) AS group_counts FROM e JOIN c USING (subject) JOIN g USING (subject) GROUP BY subject""")
def shard_counts(spark, d):
    """What manifests of saved trials count."""
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")
    n = shards.counts(epoch_trials(spark, d).withColumn("run", F.lit(0)))
    return n.withColumns({"class_counts": text("class_counts"), "group_counts": text("group_counts")})


@query(f"""WITH {E}, f AS (SELECT vec_id, CASE WHEN vec_id % 11 <> 0 AND vec_id % 19 = 0 THEN 2 ELSE 1 END AS k FROM e) SELECT 'ids_present' AS rule, count(*) FILTER (vec_id % 11 = 0) AS n_violations FROM e UNION ALL SELECT 'binary_label', CAST(sum(k) FILTER (vec_id % 7 = 0) AS BIGINT) FROM f UNION ALL SELECT 'finite', CAST(sum(k) FILTER (vec_id % 13 = 0) AS BIGINT) FROM f
UNION ALL SELECT 'even_channels', CAST(sum(k) FILTER (vec_id % 17 = 0 AND vec_id % 13 <> 0) AS BIGINT) FROM f UNION ALL SELECT 'unique_trials', count(*) FILTER (vec_id % 11 <> 0 AND vec_id % 19 = 0) FROM e""")
def trial_rules(spark, d):
    """Trials with blank runs, labels of 2, infinite values, channels of unequal length, and some of them twice."""
    at = lambda n: F.substring("trial_uid", 3, 20).cast("long") % n == 0
    t = epoch_trials(spark, d).withColumn("run", F.when(at(11), " ").otherwise("0"))
    t = t.withColumn("label", F.when(at(7), 2).otherwise(F.col("label")))
    bad = F.transform("x", lambda c: F.transform(c, lambda v: F.lit(float("inf"))))
    short = F.transform("x", lambda c, i: F.when(i == 0, F.slice(c, 1, 3)).otherwise(c))
    t = t.withColumn("x", F.when(at(13), bad).when(at(17), short).otherwise(F.col("x")))
    t = t.unionByName(t.filter(at(19) & ~at(11)))
    rules = shards.shard_rules(t)
    return plans.audit({k: rules[k] for k in ("ids_present", "binary_label", "finite", "even_channels", "unique_trials")})


@query(f"""WITH {E} SELECT 'E' AS dataset, count(DISTINCT CASE WHEN subject = '3' THEN 3 ELSE 4 END) AS n FROM e HAVING n > 1""")
def incompatible_shapes(spark, d):
    """A dataset of which one subject has a channel less."""
    x = F.when(F.col("subject") == "3", F.slice("x", 1, 3)).otherwise(F.col("x"))
    return shards.incompatible(epoch_trials(spark, d).withColumn("x", x))


@query(f"""WITH {SAMPLE}, c AS (SELECT dataset, subject, least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) AS c FROM s WHERE role = 'calibration_pool' GROUP BY ALL)
SELECT dataset, subject, CAST(budget AS INTEGER) AS budget, 2 * budget::BIGINT AS n, budget::BIGINT AS class_1, 0::BIGINT AS first_place FROM c, (SELECT unnest({BUDGETS}) AS budget) WHERE budget <= c""")
def numpy_samples(spark, d):
    """Sizes of samples drawn from NumPy's streams."""
    p = pool(spark, d)
    at = reuse.positions(p)
    got = bootstrap.nested_samples(p.join(at, ["dataset", "subject", "trial_uid"]), BUDGETS, SEED, short="skip")
    return got.groupBy("dataset", "subject", "budget").agg(F.count("*").alias("n"), F.sum("label").alias("class_1"), F.min("place").cast("long").alias("first_place"))


@query()
def numpy_bootstrap_ci(spark, d):
    """Intervals of paired differences from NumPy's streams."""
    x = curves.scoped(differences(spark, d))
    return rounded(bootstrap.intervals(x, ["scope", "method", "budget"], "difference", 2000, 0.95, bootstrap.paired_seed(SEED, "roc_auc")))


@query()
def contrast_trajectory(spark, d):
    return rounded(statistics.trajectory(summary(spark, d), SETTINGS))


@query(f"""WITH {TRIALS}, r AS (SELECT * REPLACE ('E' || (user_id % 2) AS dataset) FROM (SELECT t.*, CAST(subject AS BIGINT) AS user_id FROM t)), e AS (SELECT dataset, subject, session, run, trial_uid, label FROM t UNION ALL SELECT dataset, subject, session, run, 'E' || trial_uid, label FROM r WHERE label = 1),
 pos AS (SELECT *, row_number() OVER (PARTITION BY dataset, subject ORDER BY session, run, trial_uid) - 1 AS position FROM e),
 s AS (SELECT *, CASE WHEN session = hi THEN 'test' WHEN lo < hi THEN 'calibration_pool' END AS role FROM (SELECT *, max(session) OVER (PARTITION BY dataset, subject) AS hi, min(session) OVER (PARTITION BY dataset, subject) AS lo FROM pos) WHERE lo < hi)
SELECT dataset, subject AS target_subject, role, count(*) AS n, min(position) AS first_position, max(position) AS last_position, sum(position)::BIGINT AS positions FROM s GROUP BY ALL""")
def reused_split_rows(spark, d):
    """Assigned trials taken up again by position, where ids of subjects recur in other datasets with other trials."""
    t = sources.trials(spark, d).drop("value")
    twin = t.filter("label = 1").withColumns({"dataset": F.concat(F.lit("E"), (F.col("subject").cast("long") % 2).cast("string")), "trial_uid": F.concat(F.lit("E"), "trial_uid")})
    both = t.unionByName(twin)
    assigned = assign.latest_session(both).select("dataset", F.col("subject").alias("target_subject"), "trial_uid", "role")
    g = reuse.placed(assigned, both).groupBy("dataset", "target_subject", "role")
    return g.agg(F.count("*").alias("n"), F.min("position").cast("long").alias("first_position"), F.max("position").cast("long").alias("last_position"), F.sum("position").alias("positions"))
