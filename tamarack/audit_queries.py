"""Queries of audits, comparisons and reports, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tamarack import functions as fn
from tamarack import plans, sources
from tamarack.operators import assign, curves, statistics
from tamarack.queries import CELLS, MODES, ORACLES, PAIR, PREDICTIONS, REPEAT, SEED, SPLIT, SUMMARY, TRIALS, K, conditions, query, rounded, summary
from tamarack.sources import METRICS

ANY_NULL = " OR ".join(f"{c} IS NULL" for c in METRICS)


@query(f"""WITH {CELLS} SELECT 'unique_conditions' AS rule, count(*) - count(DISTINCT ({K})) AS n_violations FROM m UNION ALL SELECT 'known_regime', count(*) FILTER (regime NOT IN ('population', 'subject', 'source_plus_target')) FROM m
UNION ALL SELECT 'population_at_zero', count(*) FILTER (regime = 'population' AND budget <> 0) FROM m UNION ALL SELECT 'subject_above_zero', count(*) FILTER (regime = 'subject' AND budget <= 0) FROM m
UNION ALL SELECT 'metrics_complete', count(*) FILTER ({ANY_NULL}) FROM m UNION ALL SELECT 'auc_in_range', count(*) FILTER (roc_auc < 0 OR roc_auc > 1) FROM m""")
def audit_metric_protocol(spark, d):
    return plans.audit(plans.metric_rules(conditions(spark, d), REPEAT, METRICS))


@query(f"""WITH {CELLS}, f AS (SELECT {K}, count(*) AS n_found FROM p WHERE s < 0.9 GROUP BY ALL) SELECT {', '.join(f'm.{k.strip()}' for k in K.split(','))}, n_trials, n_found FROM m LEFT JOIN f USING ({K}) WHERE n_trials IS DISTINCT FROM n_found""")
def audit_prediction_counts(spark, d):
    """Against predictions that lack the scores from 0.9."""
    return plans.miscounted(conditions(spark, d), sources.predictions(spark, d).filter("y_score < 0.9"), REPEAT)


@query(f"WITH {CELLS} SELECT {K} FROM m WHERE repeat = 1 AND roc_auc IS NOT NULL")
def audit_recompute_tolerance(spark, d):
    """Against a copy whose second repeat is a thousandth off."""
    m = conditions(spark, d)
    off = m.withColumn("roc_auc", F.when(F.col("repeat") == 1, F.col("roc_auc") + 1e-3).otherwise(F.col("roc_auc")))
    return plans.recomputed(off, m, REPEAT, METRICS, 1e-9)


@query(f"WITH {PREDICTIONS} SELECT dataset, method, count(*) AS n_violations FROM p WHERE budget = 0 AND y = 0 GROUP BY ALL")
def audit_zero_budget_duplicate(spark, d):
    """Population predictions against a pooled copy that lacks the negatives."""
    p = sources.predictions(spark, d).filter("budget = 0").select("dataset", "target_subject", "repeat", "method", "trial_uid", "y_true", "y_score")
    gone = plans.unlike_scores(p, p.filter("y_true = 1"), ["dataset", "target_subject", "repeat", "method", "trial_uid"])
    return gone.groupBy("dataset", "method").agg(F.count("*").alias("n_violations"))


@query(f"""WITH {CELLS} SELECT 'score_in_range' AS rule, count(*) FILTER (s IS NULL OR s < 0 OR s > 1) AS n_violations FROM p UNION ALL SELECT 'prediction_is_threshold', count(*) FILTER (s >= 0.5 AND s < 0.6) FROM p UNION ALL SELECT 'binary_label', count(*) FILTER (y NOT IN (0, 1)) FROM p
UNION ALL SELECT 'both_labels', count(*) FILTER (n1 = 0 OR n0 = 0) FROM g""")
def audit_predictions(spark, d):
    """Against predictions made at 0.6."""
    p = sources.predictions(spark, d).withColumn("y_pred", (F.col("y_score") >= 0.6).cast("int"))
    return plans.audit(plans.prediction_rules(p, REPEAT))


BALANCED = TRIALS + f""", c AS (SELECT *, least(count(*) FILTER (label = 0) OVER (PARTITION BY dataset, subject), count(*) FILTER (label = 1) OVER (PARTITION BY dataset, subject), 20) AS n, row_number() OVER (PARTITION BY dataset, subject, label ORDER BY md5('{SEED}:' || trial_uid), trial_uid) AS place FROM t),
 o AS (SELECT * FROM c WHERE place <= n AND NOT (label = 0 AND right(trial_uid, 1) = '3'))"""


@query(f"""WITH {BALANCED}, b AS (SELECT DISTINCT dataset, subject FROM t), x AS (SELECT a.dataset, a.subject, least(count(*), 10) + CAST(right(a.subject, 1) = '4' AS INTEGER) AS n FROM b a JOIN b c ON a.dataset = c.dataset AND a.subject <> c.subject GROUP BY a.dataset, a.subject),
 k AS (SELECT dataset, subject, count(*) FILTER (label = 0) AS c0, count(*) FILTER (label = 1) AS c1 FROM o GROUP BY ALL)
SELECT 'target_is_no_source' AS rule, count(*) FILTER (right(subject, 1) = '4') AS n_violations FROM x UNION ALL SELECT 'source_cap', count(*) FILTER (n > 9) FROM x UNION ALL SELECT 'trial_cap', count(*) FILTER (greatest(c0, c1) > 12) FROM k UNION ALL SELECT 'balanced', count(*) FILTER (c0 <> c1) FROM k""")
def audit_sources(spark, d):
    """Ten sources and twenty trials a class against caps of nine and twelve; subjects in 4 are their own source too, and negatives in 3 lack."""
    t = sources.trials(spark, d)
    chosen = sources.kept(assign.sources(t, 10, SEED)).drop("place")  # two rules read them
    own = t.select("dataset", F.col("subject").alias("target_subject"), F.col("subject").alias("source_subject")).distinct().filter(F.substring("target_subject", -1, 1) == "4")
    taken = assign.balanced(t, 20, SEED).filter(~((F.col("label") == 0) & (F.substring("trial_uid", -1, 1) == "3")))
    return plans.audit(plans.source_rules(chosen.unionByName(own), taken, 9, 12))


@query(f"WITH {SPLIT} SELECT dataset, count(*) AS n_violations FROM s WHERE role = 'test' AND value > 50 GROUP BY ALL")
def audit_test_set_equality(spark, d):
    """Assigned test trials against predicted ones that lack values over 50."""
    test = assign.latest_session(sources.trials(spark, d)).filter("role = 'test'")
    gone = plans.unlike(test, test.filter("value <= 50 or value is null"), ["dataset", "subject", "trial_uid"])
    return gone.groupBy("dataset").agg(F.count("*").alias("n_violations"))


@query(f"""WITH {CELLS}, c AS (SELECT 'population' AS regime, 0 AS budget UNION ALL SELECT 'source_plus_target', 0 UNION ALL SELECT r, b FROM (SELECT unnest(['subject', 'source_plus_target']) AS r), (SELECT unnest([5, 10, 20, 40]) AS b)),
 o AS (SELECT {K} FROM m), e AS (SELECT dataset, target_subject, repeat, method, regime, budget FROM (SELECT DISTINCT dataset, target_subject, repeat FROM m), (SELECT unnest(['csp_lda', 'riemann_lr', 'logvar_lda']) AS method), c)
SELECT *, 'missing' AS side FROM (SELECT * FROM e EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM o EXCEPT SELECT * FROM e)""")
def grid_symmetric_diff(spark, d):
    m = sources.kept(conditions(spark, d).select(*REPEAT))  # the grid and what is held against it
    return plans.grid_difference(assign.grid(m.select("dataset", "target_subject", "repeat").distinct(), MODES, [0, 5, 10, 20, 40]), m, REPEAT)


@query(f"""WITH {TRIALS}, c AS (SELECT dataset, subject, session, count(DISTINCT run) AS runs, least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) AS n FROM t GROUP BY ALL)
SELECT dataset, subject, count(*) AS n_sessions, max(runs) AS n_runs, min(n) AS least_of_class, count(*) = 3 AND max(runs) = 4 AND min(n) >= 5 AS as_expected FROM c GROUP BY ALL""")
def structure_expectations(spark, d):
    return plans.structure(sources.trials(spark, d), 3, 4, 5)


@query(f"""WITH {SPLIT} SELECT dataset, subject, count(*) AS n_trials, count(*) FILTER (label = 0) AS class_0, count(*) FILTER (label = 1) AS class_1, count(DISTINCT session) AS n_sessions, count(DISTINCT (session, run)) AS n_groups,
 count(*) FILTER (role = 'test') AS n_test, count(*) FILTER (role = 'calibration_pool') AS n_pool, string_agg(DISTINCT CAST(session AS VARCHAR), ';') FILTER (role = 'test') AS test_sessions FROM s GROUP BY ALL""")
def dataset_report(spark, d):
    role, n = F.col("role"), F.count_if
    return assign.latest_session(sources.trials(spark, d)).groupBy("dataset", "subject").agg(
        F.count("*").alias("n_trials"), n(F.col("label") == 0).alias("class_0"), n(F.col("label") == 1).alias("class_1"), F.countDistinct("session").alias("n_sessions"),
        F.countDistinct("session", "run").alias("n_groups"), n(role == "test").alias("n_test"), n(role == "calibration_pool").alias("n_pool"),
        F.array_join(F.array_sort(F.collect_set(F.when(role == "test", F.col("session").cast("string")))), ";").alias("test_sessions"),
    )


@query(f"""WITH {TRIALS} SELECT trial_uid, printf('%s:%s:%d:%d:%05d', dataset, subject, session, run, CAST(substr(trial_uid, 3) AS BIGINT)) AS uid, dataset || '::' || subject AS participant FROM t""")
def trial_uid_format(spark, d):
    number = F.substring("trial_uid", 3, 20).cast("long")
    uid = fn.trial_uid(F.col("dataset"), F.col("subject"), F.col("session").cast("string"), F.col("run").cast("string"), number)
    return sources.trials(spark, d).select("trial_uid", uid.alias("uid"), F.concat_ws("::", "dataset", "subject").alias("participant"))


@query(f"""WITH {SPLIT} SELECT dataset, subject, substr(sha256('{{"strategy":"latest_session","test":["' || string_agg(trial_uid, '","' ORDER BY trial_uid) FILTER (role = 'test') || '"]}}'), 1, 20) AS split_id FROM s GROUP BY ALL""")
def split_id_digest(spark, d):
    s = assign.latest_session(sources.trials(spark, d)).filter("role = 'test'").groupBy("dataset", "subject").agg(F.array_sort(F.collect_list("trial_uid")).alias("test"))
    return s.select("dataset", "subject", fn.fingerprint(fn.canonical_json(strategy=F.lit("latest_session"), test=F.col("test")), 20).alias("split_id"))


@query(f"""WITH {TRIALS} SELECT dataset, name, n, CAST(row_number() OVER (PARTITION BY dataset ORDER BY k) AS INTEGER) AS place FROM (SELECT dataset, 'S' || subject AS name, CAST(subject AS BIGINT) AS k, count(*) AS n FROM t GROUP BY ALL)""")
def natural_sort(spark, d):
    s = sources.trials(spark, d).groupBy("dataset", F.concat(F.lit("S"), "subject").alias("name")).agg(F.count("*").alias("n"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("dataset").orderBy(fn.natural_key(F.col("name")))))


@query(f"""WITH {SUMMARY} SELECT x.dataset, x.target_subject, x.regime, x.budget, round(y.roc_auc - x.roc_auc, 6) + 0.0::DOUBLE AS difference FROM a x JOIN a y USING (dataset, target_subject, regime, budget)
WHERE x.method = 'csp_lda' AND y.method = 'riemann_lr' AND x.roc_auc IS NOT NULL AND y.roc_auc IS NOT NULL""")
def paired_method_pivot(spark, d):
    return rounded(curves.paired(summary(spark, d), "method", "csp_lda", "riemann_lr", ["dataset", "target_subject", "regime", "budget"], "roc_auc"))


RUNS = SUMMARY + """, f AS (SELECT method, budget, avg(y.roc_auc - x.roc_auc) AS v FROM a x JOIN a y USING (dataset, target_subject, method, budget) WHERE x.regime = 'subject' AND y.regime = 'source_plus_target' GROUP BY ALL)"""


@query(f"""WITH {RUNS} SELECT budget, round(x.v, 6) + 0.0::DOUBLE AS "primary", round(y.v, 6) + 0.0::DOUBLE AS other, round(y.v - x.v, 6) + 0.0::DOUBLE AS change, sign(x.v) = sign(y.v) AS direction_consistent,
 CASE WHEN abs(y.v) > abs(x.v) THEN 'increased' WHEN abs(y.v) < abs(x.v) THEN 'decreased' ELSE 'unchanged' END AS magnitude_change
FROM (SELECT * FROM f WHERE method = 'csp_lda') x FULL JOIN (SELECT * FROM f WHERE method = 'riemann_lr') y USING (budget)""")
def cross_run_compare(spark, d):
    x = curves.paired(summary(spark, d), "regime", "subject", "source_plus_target", ["method", "budget", "dataset", "target_subject"], "roc_auc").groupBy("method", "budget").agg(F.avg("difference").alias("v"))
    return rounded(statistics.cross_run(x.filter("method = 'csp_lda'"), x.filter("method = 'riemann_lr'"), ["budget"], "v"))


@query(f"""WITH {PAIR}, q AS (SELECT method, budget, scope, difference, rank() OVER (PARTITION BY method, budget, scope ORDER BY abs(difference)) + (count(*) OVER (PARTITION BY method, budget, scope, abs(difference)) - 1) / 2.0::DOUBLE AS rk FROM sc WHERE difference <> 0),
 w AS (SELECT method, budget, scope, sum(rk * sign(difference)) / sum(rk) AS r FROM q GROUP BY ALL), b AS (SELECT method, budget, scope, count(*) AS n_pairs, avg(difference) AS mean, median(difference) AS median FROM sc GROUP BY ALL)
SELECT method, budget, scope, n_pairs, round(mean, 6) + 0.0::DOUBLE AS mean, round(median, 6) + 0.0::DOUBLE AS median, round(coalesce(r, 0), 6) + 0.0::DOUBLE AS rank_biserial,
 CASE scope WHEN 'ALL' THEN 'regime_confirmatory' ELSE 'regime_dataset_supportive' END AS family, CASE scope WHEN 'ALL' THEN 'confirmatory' ELSE 'supportive' END AS inference_role FROM b LEFT JOIN w USING (method, budget, scope)""")
def forest_rows(spark, d):
    return rounded(statistics.regime_family(summary(spark, d), [5, 10, 20, 40], "roc_auc").select("method", "budget", "scope", "n_pairs", "mean", "median", "rank_biserial", "family", "inference_role"))


#: Signed-rank p-values over w (keys, n, zeros, ties, w_plus, w_minus): exact up to 50 differences without zeros and ties, else normal with tie correction.
WAYS = """ways(k, c) AS (SELECT 0, [1.0::DOUBLE] UNION ALL SELECT k + 1, [coalesce(CASE WHEN i <= len(c) THEN c[i] END, 0) + coalesce(CASE WHEN i > k + 1 THEN c[i - k - 1] END, 0) FOR i IN range(1, len(c) + k + 2)] FROM ways WHERE k < 50)"""
ERF = "list_sum([exp((2 * i + 1) * ln(z / sqrt(2)) - lgamma(i + 1.5) - z * z / 2) FOR i IN range(0, 200)])"


def p_sql(keys: str) -> str:
    return f"""h AS (SELECT {keys}, abs(difference) AS a, difference, rank() OVER (PARTITION BY {keys} ORDER BY abs(difference)) + (count(*) OVER (PARTITION BY {keys}, abs(difference)) - 1) / 2.0::DOUBLE AS rk,
 count(*) OVER (PARTITION BY {keys}, abs(difference)) AS same FROM sc WHERE difference <> 0),
 ww AS (SELECT {keys}, count(*) AS n, coalesce(sum(rk) FILTER (difference > 0), 0) AS up, coalesce(sum(rk) FILTER (difference < 0), 0) AS down, sum(same * same - 1) AS ties FROM h GROUP BY ALL),
 bb AS (SELECT {keys}, count(*) AS n_pairs, avg(difference) AS mean, median(difference) AS median, count(*) FILTER (difference = 0) AS zeros FROM sc GROUP BY ALL),
 z AS (SELECT {keys}, n_pairs, mean, median, zeros, coalesce(n, 0) AS n, coalesce(least(up, down), 0) AS statistic, coalesce((up - down) / (up + down), 0) AS rank_biserial, coalesce(ties, 0) AS ties,
 abs(least(up, down) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS z FROM bb LEFT JOIN ww USING ({keys})),
 sp AS (SELECT z.*, CASE WHEN n = 0 THEN 1.0 WHEN n <= 50 AND ties = 0 AND zeros = 0 THEN least(1.0, 2 * list_sum(c[1:CAST(floor(statistic) AS BIGINT) + 1]) / pow(2, n)) WHEN z.z = 0 THEN 1.0 ELSE 1 - {ERF.replace('z', 'z.z')} END::DOUBLE AS p FROM z LEFT JOIN ways ON k = n)"""


def tests_sql(keys: str, kind: str) -> str:
    """Tests by keys, Holm-corrected in each family."""
    return f"""f AS (SELECT sp.*, CASE scope WHEN 'ALL' THEN '{kind}_confirmatory' ELSE '{kind}_dataset_supportive' END AS family, CASE scope WHEN 'ALL' THEN 'confirmatory' ELSE 'supportive' END AS inference_role FROM sp),
 y AS (SELECT *, (count(p) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p NULLS LAST, {keys}) + 1) * p AS step FROM f)
SELECT {keys}, n_pairs, round(mean, 6) + 0.0::DOUBLE AS mean, round(median, 6) + 0.0::DOUBLE AS median, round(statistic, 6)::DOUBLE AS statistic, round(p, 6) AS p, round(rank_biserial, 6) + 0.0::DOUBLE AS rank_biserial, family, inference_role,
 round(least(1.0::DOUBLE, max(step) OVER (PARTITION BY family ORDER BY p NULLS LAST, {keys} ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM y"""


@query(f"""WITH RECURSIVE {WAYS}, {PAIR.replace('FROM d, LATERAL', 'FROM (SELECT * FROM d WHERE budget IN (5, 10)) d, LATERAL')}, {p_sql('method, budget, scope')}, {tests_sql('method, budget, scope', 'regime')}""")
def regime_tests(spark, d):
    """Exact or normal p-values of source_plus_target against subject, Holm-corrected in each family."""
    return rounded(statistics.regime_family(summary(spark, d), [5, 10], "roc_auc"))


AREAS = ORACLES["aucc_norm"].split("SELECT dataset, target_subject, method, regime, array_to_string")[0]
METHODS = AREAS + """, d AS (SELECT x.regime, x.dataset, x.target_subject, y.area - x.area AS difference FROM e x JOIN e y USING (dataset, target_subject, regime) WHERE x.method = 'csp_lda' AND y.method = 'riemann_lr' AND x.seen = [5, 10, 20] AND y.seen = [5, 10, 20] AND x.area IS NOT NULL AND y.area IS NOT NULL),
 sc AS (SELECT d.*, scope FROM d, LATERAL (SELECT unnest(CASE WHEN (SELECT count(DISTINCT dataset) FROM d) > 1 THEN [d.dataset, 'ALL'] ELSE [d.dataset] END) AS scope) u)"""


@query(f"""WITH RECURSIVE {WAYS}, {METHODS.removeprefix('WITH ')}, {p_sql('regime, scope')}, {tests_sql('regime, scope', 'aucc')}""")
def method_tests(spark, d):
    return rounded(statistics.method_family(curves.aucc(summary(spark, d), "roc_auc", [5, 10, 20], 20)))


@query(f"""WITH {SUMMARY} SELECT dataset, target_subject, 'b' || budget AS name, round(max(roc_auc), 6) AS v FROM a WHERE method = 'csp_lda' AND regime = 'subject' AND budget IN (5, 10, 20) AND roc_auc IS NOT NULL GROUP BY ALL""")
def heatmap_unpivot(spark, d):
    s = summary(spark, d).filter("method = 'csp_lda' and regime = 'subject'")
    wide = s.groupBy("dataset", "target_subject").pivot("budget", [5, 10, 20]).agg(F.max("roc_auc")).withColumnsRenamed({"5": "b5", "10": "b10", "20": "b20"})
    return rounded(wide.unpivot(["dataset", "target_subject"], ["b5", "b10", "b20"], "name", "v").dropna(subset=["v"]))


@query(f"""WITH {SUMMARY}, x AS (SELECT dataset, target_subject, avg(roc_auc) AS v FROM a WHERE roc_auc IS NOT NULL GROUP BY ALL)
SELECT dataset, target_subject, round(v, 6) AS mean, CAST(row_number() OVER (PARTITION BY dataset ORDER BY round(v, 6) DESC, CAST(target_subject AS BIGINT)) - 1 AS INTEGER) AS place FROM x""")
def participant_order(spark, d):
    x = rounded(summary(spark, d).filter("roc_auc is not null").groupBy("dataset", "target_subject").agg(F.avg("roc_auc").alias("mean")))
    w = Window.partitionBy("dataset").orderBy(F.desc("mean"), fn.subject_key(F.col("target_subject")))
    return x.withColumn("place", F.row_number().over(w) - 1)


@query(f"""WITH {SUMMARY} SELECT method, regime, budget, round(min(roc_auc), 6) AS low, round(quantile_cont(roc_auc, 0.25), 6) AS q1, round(median(roc_auc), 6) AS mid, round(quantile_cont(roc_auc, 0.75), 6) AS q3, round(max(roc_auc), 6) AS high FROM a GROUP BY ALL""")
def box_summary(spark, d):
    x = F.col("roc_auc")
    return rounded(summary(spark, d).groupBy("method", "regime", "budget").agg(F.min(x).alias("low"), F.percentile(x, F.lit(0.25)).alias("q1"), F.median(x).alias("mid"), F.percentile(x, F.lit(0.75)).alias("q3"), F.max(x).alias("high")))


@query(f"""WITH {TRIALS}, e AS (SELECT * FROM (VALUES ('D0', 50), ('D1', 40), ('D2', 60)) v(dataset, planned)), f AS (SELECT dataset, count(DISTINCT subject) AS seen, count(*) AS n_trials FROM t GROUP BY ALL)
SELECT dataset, CAST(planned AS INTEGER) AS planned, coalesce(seen, 0) AS seen, coalesce(n_trials, 0) AS n_trials, coalesce(seen, 0) = planned AS complete FROM e LEFT JOIN f USING (dataset)""")
def cohort_table(spark, d):
    f = sources.trials(spark, d).groupBy("dataset").agg(F.countDistinct("subject").alias("seen"), F.count("*").alias("n_trials"))
    e = spark.createDataFrame([("D0", 50), ("D1", 40), ("D2", 60)], "dataset string, planned int")
    g = e.join(f, "dataset", "left").fillna(0, ["seen", "n_trials"])
    return g.withColumn("complete", F.col("seen") == F.col("planned"))


@query(f"WITH {PREDICTIONS} SELECT dataset, target_subject, method, repeat, count(*) AS n_rows FROM p WHERE repeat <> 0 GROUP BY ALL")
def append_once_partial_guard(spark, d):
    """What a keyed append adds to a table that has the first repeat; a key with some of its rows only would raise."""
    p = sources.predictions(spark, d)
    new = p.join(p.groupBy(*REPEAT).agg(F.count("*").alias("n_expected")), REPEAT)
    return sources.append_once(new, p.filter("repeat = 0"), REPEAT).groupBy("dataset", "target_subject", "method", "repeat").agg(F.count("*").alias("n_rows"))
