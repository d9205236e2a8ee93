"""A query for each operator, over whole tables, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack import functions as fn
from tamarack import plans, sources
from tamarack.operators import assign, curves, metrics
from tamarack.sources import CONDITION, METRICS

REPEAT = [*CONDITION[:2], "repeat", *CONDITION[2:]]
POOL, SEED, BUDGETS, MODES = 8, 20260811, [1, 2, 4, 8], ["csp_lda", "riemann_lr", "logvar_lda"]
ROUND = 6
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def rounded(df: DataFrame, digits: int = ROUND) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def conditions(spark, d) -> DataFrame:
    return metrics.binary_metrics(sources.predictions(spark, d), REPEAT)


def summary(spark, d) -> DataFrame:
    return curves.repeat_average(conditions(spark, d))


def pool(spark, d) -> DataFrame:
    return assign.latest_session(sources.trials(spark, d)).filter("role = 'calibration_pool'")


def sample(spark, d) -> DataFrame:
    return assign.nested(pool(spark, d), BUDGETS, SEED)


TRIALS = """t AS (SELECT 'D' || CAST(user_id % 3 AS VARCHAR) AS dataset, CAST(user_id AS VARCHAR) AS subject, CAST((day(ts) - 1) // 10 AS INTEGER) AS session, CAST(hour(ts) // 6 AS INTEGER) AS run,
 'E:' || CAST(event_id AS VARCHAR) AS trial_uid, CAST(event_type IN ('purchase', 'signup') AS INTEGER) AS label, value FROM events WHERE event_type <> 'error')"""
SPLIT = TRIALS + """, s AS (SELECT *, CASE WHEN session = hi THEN 'test' ELSE 'calibration_pool' END AS role FROM (SELECT *, max(session) OVER (PARTITION BY dataset, subject) AS hi, min(session) OVER (PARTITION BY dataset, subject) AS lo FROM t) WHERE lo < hi)"""
SAMPLE = SPLIT + f""", pl AS (SELECT *, row_number() OVER (PARTITION BY dataset, subject, label ORDER BY md5('{SEED}:' || trial_uid), trial_uid) AS place,
 least(count(*) FILTER (label = 0) OVER (PARTITION BY dataset, subject), count(*) FILTER (label = 1) OVER (PARTITION BY dataset, subject)) AS c FROM s WHERE role = 'calibration_pool'),
 n AS (SELECT dataset, subject, label, trial_uid, budget, min(budget) OVER (PARTITION BY dataset, subject, trial_uid) AS selected_at_budget FROM pl, (SELECT unnest([1, 2, 4, 8]) AS budget) b WHERE place <= budget AND budget <= c)"""
PREDICTIONS = """j AS (SELECT *, substr(o_orderpriority, 1, 1) AS pr FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 p AS (SELECT l_linestatus AS dataset, CAST(l_suppkey % 20 AS VARCHAR) AS target_subject, CAST(l_linenumber % 3 AS INTEGER) AS repeat, method,
 CASE WHEN pr = '1' THEN 'population' WHEN l_partkey % 2 = 0 THEN 'subject' ELSE 'source_plus_target' END AS regime,
 CASE pr WHEN '1' THEN 0 WHEN '2' THEN 5 WHEN '3' THEN 10 WHEN '4' THEN 20 ELSE 40 END AS budget, CAST(l_returnflag = 'R' AS INTEGER) AS y,
 greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE method WHEN 'csp_lda' THEN l_discount * 10 WHEN 'riemann_lr' THEN l_quantity / 50 ELSE (l_discount * 10 + l_quantity / 50) / 2 END)) AS s
 FROM j, (SELECT unnest(['csp_lda', 'riemann_lr', 'logvar_lda']) AS method) m)"""
K = "dataset, target_subject, repeat, method, regime, budget"
CELLS = PREDICTIONS + f""", r AS (SELECT *, rank() OVER (PARTITION BY {K} ORDER BY s) + (count(*) OVER (PARTITION BY {K}, s) - 1) / 2.0::DOUBLE AS rk FROM p),
 g AS (SELECT {K}, count(*) AS n, sum(y) AS n1, count(*) - sum(y) AS n0, sum(CASE WHEN y = 1 THEN rk END) AS rs, count(*) FILTER (y = 1 AND s >= 0.5) AS tp, count(*) FILTER (y = 0 AND s >= 0.5) AS fp,
 avg((s - y) * (s - y)) AS br, avg(-(y * ln(greatest(1e-7, least(1 - 1e-7, s))) + (1 - y) * ln(1 - greatest(1e-7, least(1 - 1e-7, s))))) AS ll FROM r GROUP BY ALL),
 m AS (SELECT {K}, CAST(n AS BIGINT) AS n_trials, CASE WHEN n1 * n0 > 0 THEN (rs - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0) END AS roc_auc,
 CASE WHEN n1 * n0 > 0 THEN (tp / n1::DOUBLE + (n0 - fp) / n0::DOUBLE) / 2 END AS balanced_accuracy, CASE WHEN n1 * n0 > 0 THEN (tp + n0 - fp) / n::DOUBLE END AS accuracy,
 CASE WHEN n1 * n0 > 0 THEN (coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + n1 - tp, 0), 0) + coalesce(2.0::DOUBLE * (n0 - fp) / nullif(2 * (n0 - fp) + (n1 - tp) + fp, 0), 0)) / 2 END AS macro_f1,
 CASE WHEN n1 * n0 > 0 THEN br END AS brier, CASE WHEN n1 * n0 > 0 THEN ll END AS log_loss FROM g)"""
S6 = ", ".join(f"round({c}, 6) AS {c}" for c in METRICS)
SUMMARY = CELLS + f""", a AS (SELECT dataset, target_subject, method, regime, budget, {', '.join(f'avg({c}) AS {c}' for c in METRICS)}, count(*) AS n_repeats_observed, log2(budget + 1) AS log2_budget FROM m GROUP BY ALL)"""
PAIR = SUMMARY + """, d AS (SELECT x.method, x.budget, x.dataset, x.target_subject, y.roc_auc - x.roc_auc AS difference FROM a x JOIN a y ON x.regime = 'subject' AND y.regime = 'source_plus_target' AND x.dataset = y.dataset AND x.target_subject = y.target_subject AND x.method = y.method AND x.budget = y.budget
 WHERE x.roc_auc IS NOT NULL AND y.roc_auc IS NOT NULL), sc AS (SELECT d.*, scope FROM d, LATERAL (SELECT unnest([d.dataset, 'ALL']) AS scope) u)"""


@query(f"WITH {CELLS} SELECT {K}, n_trials, {S6.replace(', 6)', ', 9)')} FROM m")
def cond_metrics_all6(spark, d):
    return rounded(conditions(spark, d), 9)


@query(f"WITH {SUMMARY} SELECT dataset, target_subject, method, regime, budget, {S6}, n_repeats_observed, round(log2_budget, 6) AS log2_budget FROM a")
def repeat_average(spark, d):
    return rounded(summary(spark, d))


@query(f"""WITH {SUMMARY}, l AS (UNPIVOT (SELECT dataset, method, regime, budget, {', '.join(METRICS)} FROM a) ON {', '.join(METRICS)} INTO NAME metric VALUE v)
SELECT dataset, method, regime, budget, metric, round(avg(v), 6) AS mean, count(*) AS n, round(stddev_samp(v), 6) AS sd, round(median(v), 6) AS median FROM l GROUP BY ALL""")
def curve_long_stats(spark, d):
    return rounded(curves.curve_long(summary(spark, d)))


@query(f"""WITH {SUMMARY}, i AS (SELECT *, budget <= 20 AND roc_auc IS NOT NULL AS inside FROM a WHERE regime <> 'population'), c AS (SELECT *, log2(budget + 1) AS x, (log2(budget + 1) - lag(log2(budget + 1)) OVER w) * (roc_auc + lag(roc_auc) OVER w) / 2 AS part FROM i
 WINDOW w AS (PARTITION BY dataset, target_subject, method, regime, inside ORDER BY budget)),
 e AS (SELECT dataset, target_subject, method, regime, coalesce(list_sort(list(DISTINCT budget) FILTER (inside)), []) AS seen, sum(part) FILTER (inside) / nullif(max(x) FILTER (inside) - min(x) FILTER (inside), 0) AS area, regr_slope(roc_auc, x) FILTER (inside) AS slope, min(budget) FILTER (inside AND roc_auc >= 0.5) AS fb FROM c GROUP BY ALL)
SELECT dataset, target_subject, method, regime, array_to_string(seen, ';') AS observed_budgets, seen = [5, 10, 20] AS curve_complete,
 CASE WHEN seen = [5, 10, 20] THEN '' ELSE 'missing=' || array_to_string(list_filter([5, 10, 20], lambda b: NOT list_contains(seen, b)), ';') || CASE WHEN len(seen) = 0 THEN ' | no_points_within_horizon' ELSE '' END END AS reason,
 round(CASE WHEN seen = [5, 10, 20] THEN area END, 6) AS aucc, round(CASE WHEN seen = [5, 10, 20] THEN slope END, 6) AS slope, CASE WHEN seen = [5, 10, 20] THEN fb::DOUBLE END AS first_budget FROM e""")
def aucc_norm(spark, d):
    return rounded(curves.aucc(summary(spark, d), "roc_auc", [5, 10, 20], 20).withColumn("first_budget", F.col("first_budget").cast("double")))


def differences(spark, d) -> DataFrame:
    return curves.paired(summary(spark, d), "regime", "subject", "source_plus_target", ["method", "budget", "dataset", "target_subject"], "roc_auc")


@query(f"WITH {PAIR} SELECT method, budget, dataset, target_subject, round(difference, 6) + 0.0::DOUBLE AS difference FROM d")
def paired_regime_pivot(spark, d):
    return rounded(differences(spark, d))


@query(f"WITH {PAIR} SELECT method, budget, scope, count(*) AS n, round(avg(difference), 6) + 0.0::DOUBLE AS mean, round(median(difference), 6) + 0.0::DOUBLE AS median FROM sc GROUP BY ALL")
def scope_expansion(spark, d):
    return rounded(curves.scoped(differences(spark, d)).groupBy("method", "budget", "scope").agg(F.count("*").alias("n"), F.avg("difference").alias("mean"), F.median("difference").alias("median")))


SIGNED = PAIR + """, q AS (SELECT method, budget, scope, difference, rank() OVER (PARTITION BY method, budget, scope ORDER BY abs(difference)) + (count(*) OVER (PARTITION BY method, budget, scope, abs(difference)) - 1) / 2.0::DOUBLE AS rk FROM sc WHERE difference <> 0),
 w AS (SELECT method, budget, scope, count(*) AS n, coalesce(sum(rk) FILTER (difference > 0), 0) AS w_plus, coalesce(sum(rk) FILTER (difference < 0), 0) AS w_minus FROM q GROUP BY ALL)"""


@query(f"WITH {SIGNED} SELECT method, budget, scope, n, w_plus, w_minus, least(w_plus, w_minus) AS statistic, round((w_plus - w_minus) / (w_plus + w_minus), 6) AS rank_biserial FROM w")
def signed_rank_stat(spark, d):
    return rounded(curves.signed_ranks(curves.scoped(differences(spark, d)), ["method", "budget", "scope"]).drop("abs_z", "ties"))


@query(f"WITH {PAIR} SELECT method, budget, scope, count(*) FILTER (difference > 0) AS n_positive, count(*) FILTER (difference = 0) AS n_zero, count(*) FILTER (difference < 0) AS n_negative, count(*) AS n_total, round(avg(CAST(difference > 0 AS DOUBLE)), 6) AS fraction FROM sc GROUP BY ALL")
def fraction_benefiting(spark, d):
    return rounded(curves.benefit(curves.scoped(differences(spark, d)), ["method", "budget", "scope"]))


@query(f"WITH {PAIR} SELECT method, budget, round(avg(v), 6) AS mean FROM (SELECT method, budget, dataset, avg(difference) AS v FROM d GROUP BY ALL) GROUP BY ALL")
def equal_dataset_weight(spark, d):
    each = differences(spark, d).groupBy("method", "budget", "dataset").agg(F.avg("difference").alias("v"))
    return rounded(each.groupBy("method", "budget").agg(F.avg("v").alias("mean")))


@query("""WITH x AS (SELECT l_returnflag AS family, l_linestatus AS item, l_linenumber AS place, round(avg(l_discount), 6) AS p FROM lineitem GROUP BY ALL),
 y AS (SELECT *, (count(p) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p NULLS LAST, item, place) + 1) * p AS step FROM x)
SELECT family, item, place, p, round(least(1.0::DOUBLE, max(step) OVER (PARTITION BY family ORDER BY p NULLS LAST, item, place ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM y""")
def holm_by_family(spark, d):
    x = sources.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("item"), F.col("l_linenumber").alias("place")).agg(F.round(F.avg("l_discount"), 6).alias("p"))
    return rounded(curves.holm(x, "family", "p", ["item", "place"]))


@query(f"WITH {SPLIT} SELECT dataset, subject, session, run, trial_uid, label, value, role FROM s")
def latest_session_split(spark, d):
    return assign.latest_session(sources.trials(spark, d))


@query(f"""WITH {TRIALS}, g AS (SELECT dataset, subject, session, run, count(*) AS n FROM t GROUP BY ALL), u AS (SELECT *, CAST(sum(n) OVER (PARTITION BY dataset, subject ORDER BY session, run ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS n_test, sum(n) OVER (PARTITION BY dataset, subject) AS n_all FROM g)
SELECT dataset, subject, session, run, n_test FROM u WHERE n_test < n_all QUALIFY row_number() OVER (PARTITION BY dataset, subject ORDER BY n_test / n_all::DOUBLE < 0.3, CASE WHEN n_test / n_all::DOUBLE < 0.3 THEN -n_test ELSE n_test END) = 1""")
def latest_run_suffix_split(spark, d):
    return assign.run_suffix(sources.trials(spark, d), 0.3)


@query(f"""WITH {TRIALS}, g AS (SELECT dataset, subject, session, run, count(*) FILTER (label = 0) AS a, count(*) FILTER (label = 1) AS b FROM t GROUP BY ALL),
 u AS (SELECT *, sum(a) OVER l AS at_, sum(b) OVER l AS bt, sum(a) OVER w AS aa, sum(b) OVER w AS ba FROM g WINDOW w AS (PARTITION BY dataset, subject), l AS (PARTITION BY dataset, subject ORDER BY session, run ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 r AS (SELECT dataset, subject, session AS rs, run AS rr FROM u WHERE least(at_, bt) >= 9 AND least(aa - at_, ba - bt) >= 20
 QUALIFY row_number() OVER (PARTITION BY dataset, subject ORDER BY (at_ + bt) / (aa + ba)::DOUBLE < 0.3, CASE WHEN (at_ + bt) / (aa + ba)::DOUBLE < 0.3 THEN -(at_ + bt) ELSE at_ + bt END) = 1),
 k AS (SELECT t.*, rs, rr, session = max(session) OVER (PARTITION BY dataset, subject) AS x,
 row_number() OVER (PARTITION BY dataset, subject, label ORDER BY md5('{SEED}:' || trial_uid), trial_uid) <= ceil(0.3::DOUBLE * count(*) OVER (PARTITION BY dataset, subject, label)) AS y FROM t LEFT JOIN r USING (dataset, subject)),
 v AS (SELECT *, least(count(*) FILTER (x AND label = 0) OVER w, count(*) FILTER (x AND label = 1) OVER w) >= 9 AND least(count(*) FILTER (NOT x AND label = 0) OVER w, count(*) FILTER (NOT x AND label = 1) OVER w) >= 20 AS vx,
 least(count(*) FILTER (y AND label = 0) OVER w, count(*) FILTER (y AND label = 1) OVER w) >= 9 AND least(count(*) FILTER (NOT y AND label = 0) OVER w, count(*) FILTER (NOT y AND label = 1) OVER w) >= 20 AS vy FROM k WINDOW w AS (PARTITION BY dataset, subject)),
 z AS (SELECT *, CASE WHEN vx THEN 'latest_session' WHEN rs IS NOT NULL THEN 'latest_runs' WHEN vy THEN 'trial_level' END AS strategy FROM v)
SELECT dataset, subject, session, run, trial_uid, label, value, strategy, CASE strategy WHEN 'latest_session' THEN CASE WHEN x THEN 'test' ELSE 'calibration_pool' END
 WHEN 'latest_runs' THEN CASE WHEN session > rs OR (session = rs AND run >= rr) THEN 'test' ELSE 'calibration_pool' END WHEN 'trial_level' THEN CASE WHEN y THEN 'test' ELSE 'calibration_pool' END END AS role FROM z""")
def target_split_policy(spark, d):
    return assign.target_split(sources.trials(spark, d), 0.3, 9, 20, SEED, trial_level=True)


@query(f"WITH {SAMPLE} SELECT dataset, subject, label, trial_uid, budget, selected_at_budget FROM n")
def nested_calibration(spark, d):
    return sample(spark, d)


@query(f"""WITH {TRIALS}, b AS (SELECT DISTINCT dataset, subject FROM t) SELECT x.dataset, x.subject AS target_subject, y.subject AS source_subject, CAST(row_number() OVER (PARTITION BY x.dataset, x.subject ORDER BY md5('{SEED}:' || x.subject || ':' || y.subject), y.subject) AS INTEGER) AS place
FROM b x JOIN b y ON x.dataset = y.dataset AND x.subject <> y.subject QUALIFY place <= 10""")
def source_subject_choice(spark, d):
    return assign.sources(sources.trials(spark, d), 10, SEED)


@query(f"""WITH {TRIALS}, c AS (SELECT *, least(count(*) FILTER (label = 0) OVER (PARTITION BY dataset, subject), count(*) FILTER (label = 1) OVER (PARTITION BY dataset, subject), 20) AS n, row_number() OVER (PARTITION BY dataset, subject, label ORDER BY md5('{SEED}:' || trial_uid), trial_uid) AS place FROM t)
SELECT dataset, subject, session, run, trial_uid, label, value FROM c WHERE place <= n""")
def source_trial_balanced_cap(spark, d):
    return assign.balanced(sources.trials(spark, d), 20, SEED).select(*sources.TRIAL.names)


@query(f"""WITH {TRIALS} SELECT dataset, subject, count(*) AS n, count(*) FILTER (label = 0) AS class_0, count(*) FILTER (label = 1) AS class_1, sha256('["' || string_agg(trial_uid, '","' ORDER BY trial_uid) || '"]') AS digest FROM t GROUP BY ALL""")
def source_digest(spark, d):
    return assign.digests(sources.trials(spark, d))


@query(f"""WITH {SPLIT}, k AS (SELECT DISTINCT dataset, subject FROM s), c AS (SELECT 'population' AS regime, 0 AS budget UNION ALL SELECT 'source_plus_target', 0 UNION ALL SELECT r, b FROM (SELECT unnest(['subject', 'source_plus_target']) AS r), (SELECT unnest([1, 2, 4, 8]) AS b))
SELECT * FROM k, (SELECT unnest(['csp_lda', 'riemann_lr', 'logvar_lda']) AS method), c""")
def expected_grid(spark, d):
    return assign.grid(assign.latest_session(sources.trials(spark, d)).select("dataset", "subject").distinct(), MODES, BUDGETS)


@query(f"""WITH {SAMPLE}, k AS (SELECT * FROM n WHERE NOT (budget = 8 AND right(trial_uid, 1) = '3')), top AS (SELECT dataset, subject, max(budget) AS top FROM k GROUP BY ALL)
SELECT 'two_roles' AS rule, count(*) AS n_violations FROM (SELECT 1 FROM s GROUP BY dataset, subject HAVING count(DISTINCT role) <> 2)
UNION ALL SELECT 'session_in_one_role', count(*) FROM (SELECT 1 FROM s GROUP BY dataset, subject, session HAVING count(DISTINCT role) <> 1)
UNION ALL SELECT 'class_counts', count(*) FROM (SELECT budget FROM k GROUP BY dataset, subject, budget, label HAVING count(*) <> budget)
UNION ALL SELECT 'sample_in_pool', count(*) FROM k WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.trial_uid = k.trial_uid AND role = 'calibration_pool' AND right(s.trial_uid, 1) <> '7')
UNION ALL SELECT 'samples_nest', count(*) FROM k JOIN top USING (dataset, subject) WHERE budget < top AND NOT EXISTS (SELECT 1 FROM k b WHERE b.dataset = k.dataset AND b.subject = k.subject AND b.trial_uid = k.trial_uid AND b.budget = top.top)
UNION ALL SELECT 'unique_trials', count(*) FROM (SELECT 1 FROM s WHERE right(trial_uid, 1) = '5' AND right(trial_uid, 1) <> '7')""")
def audit_assignments(spark, d):
    """Against a split that has its trials in 5 twice and lacks those in 7, and samples whose largest budget lacks those in 3."""
    s = assign.latest_session(sources.trials(spark, d))
    end = F.substring("trial_uid", -1, 1)
    split = s.filter(end != "7").unionByName(s.filter(end == "5"))
    found = plans.audit(plans.assignment_rules(split, sample(spark, d).filter(~((F.col("budget") == 8) & (end == "3")))))
    return found.filter("rule not in ('two_roles', 'session_in_one_role')").unionByName(plans.audit({k: v for k, v in plans.assignment_rules(s, sample(spark, d)).items() if k in ("two_roles", "session_in_one_role")}))


@query(f"""WITH {SPLIT} SELECT dataset, subject, session, run, trial_uid, label FROM s WHERE label = 0 AND role = 'test'""")
def assign_equality_gate(spark, d):
    """Rows by which a tampered copy, without its positive test trials' opposites, differs from the assignment."""
    s = assign.latest_session(sources.trials(spark, d)).select("dataset", "subject", "session", "run", "trial_uid", "label", "role")
    kept = s.filter("not (label = 0 and role = 'test')")
    gone = plans.unequal(s, kept)
    return gone.select("dataset", "subject", F.col("session").cast("int").alias("session"), F.col("run").cast("int").alias("run"), "trial_uid", F.col("label").cast("int").alias("label"))


@query(f"WITH {CELLS} SELECT {K} FROM m WHERE repeat <> 0")
def resume_anti_join(spark, d):
    c = conditions(spark, d).select(*REPEAT)
    return c.join(c.filter("repeat = 0"), REPEAT, "left_anti").select("dataset", "target_subject", "repeat", "method", "regime", "budget")


@query(f"""WITH {TRIALS} SELECT trial_uid, CAST(('0x' || substr(sha256('[20260811,"' || dataset || '","' || subject || '"]'), 1, 8)) AS BIGINT) AS seed, substr(sha256('{{"dataset":"' || dataset || '","subject":"' || subject || '"}}'), 1, 20) AS split_id FROM t""")
def derive_seed(spark, d):
    t = sources.trials(spark, d)
    js = fn.canonical_json(dataset=F.col("dataset"), subject=F.col("subject"))
    return t.select("trial_uid", fn.derive_seed(SEED, F.col("dataset"), F.col("subject")).alias("seed"), fn.fingerprint(js, 20).alias("split_id"))


@query(f"WITH {TRIALS} SELECT subject, count(*) AS n, CAST(row_number() OVER (ORDER BY CAST(subject AS BIGINT)) AS INTEGER) AS place FROM t GROUP BY subject")
def subject_numeric_sort(spark, d):
    from pyspark.sql import Window

    s = sources.trials(spark, d).groupBy("subject").agg(F.count("*").alias("n"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(fn.subject_key(F.col("subject")))))  # a row for each subject


@query("""SELECT vec_id, round(list_aggregate([list_max(c) - list_min(c) FOR c IN x], 'median') * 1e6, 3) AS median_ptp, round(list_max([list_max(c) - list_min(c) FOR c IN x]) * 1e6, 3) AS max_ptp
FROM (SELECT vec_id, [CAST(embedding[k * 16 + 1 : k * 16 + 16] AS DOUBLE[]) FOR k IN [0, 1, 2, 3]] AS x FROM embeddings)""")
def signal_ptp(spark, d):
    p = F.array_sort(F.transform("x", lambda c: F.array_max(c) - F.array_min(c)))
    e = sources.epochs(spark, d).withColumn("p", p)
    return e.select("vec_id", F.round((F.get("p", F.lit(1)) + F.get("p", F.lit(2))) / 2 * 1e6, 3).alias("median_ptp"), F.round(F.array_max("p") * 1e6, 3).alias("max_ptp"))


@query("""SELECT vec_id, round(ln(list_aggregate(CAST(embedding[1:16] AS DOUBLE[]), 'var_samp') + 1e-12), 6) AS c1, round(ln(list_aggregate(CAST(embedding[17:32] AS DOUBLE[]), 'var_samp') + 1e-12), 6) AS c2,
 round(ln(list_aggregate(CAST(embedding[33:48] AS DOUBLE[]), 'var_samp') + 1e-12), 6) AS c3, round(ln(list_aggregate(CAST(embedding[49:64] AS DOUBLE[]), 'var_samp') + 1e-12), 6) AS c4 FROM embeddings""")
def log_variance(spark, d):
    def var(c):
        mean = F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / F.size(c)
        return F.aggregate(F.transform(c, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, v: a + v) / (F.size(c) - 1)
    f = F.transform("x", lambda c: F.ln(var(c) + 1e-12))
    e = sources.epochs(spark, d).withColumn("f", f)
    return e.select("vec_id", *[F.round(F.get("f", F.lit(k)), 6).alias(f"c{k + 1}") for k in range(4)])


@query(f"""WITH {SUMMARY} SELECT dataset, target_subject, round(max(roc_auc) FILTER (budget = 5), 6) AS b5, round(max(roc_auc) FILTER (budget = 10), 6) AS b10, round(max(roc_auc) FILTER (budget = 20), 6) AS b20 FROM a WHERE method = 'csp_lda' AND regime = 'subject' GROUP BY ALL""")
def heatmap_pivot(spark, d):
    s = summary(spark, d).filter("method = 'csp_lda' and regime = 'subject'")
    wide = s.groupBy("dataset", "target_subject").pivot("budget", [5, 10, 20]).agg(F.max("roc_auc"))
    return rounded(wide.withColumnsRenamed({"5": "b5", "10": "b10", "20": "b20"}))


@query(f"WITH {CELLS} SELECT dataset, count(DISTINCT target_subject) AS attempted, count(DISTINCT target_subject) FILTER (roc_auc IS NOT NULL) AS any_success, count(DISTINCT target_subject) FILTER (roc_auc IS NULL) AS any_failure, count(*) AS n_rows FROM m GROUP BY ALL")
def participant_flow(spark, d):
    return conditions(spark, d).groupBy("dataset").agg(
        F.countDistinct("target_subject").alias("attempted"), F.countDistinct(F.when(F.col("roc_auc").isNotNull(), F.col("target_subject"))).alias("any_success"),
        F.countDistinct(F.when(F.col("roc_auc").isNull(), F.col("target_subject"))).alias("any_failure"), F.count("*").alias("n_rows"),
    )


@query(f"""WITH {SUMMARY}, f AS (SELECT method, budget, regime, avg(roc_auc) AS v FROM a WHERE regime <> 'population' GROUP BY ALL) SELECT x.method, x.budget, x.regime, round(x.v, 6) AS mean, round(x.v - y.v, 6) + 0.0::DOUBLE AS diff_from_primary,
 CASE WHEN x.v - y.v > 0 THEN 'higher' WHEN x.v - y.v < 0 THEN 'lower' ELSE 'same' END AS direction FROM f x LEFT JOIN f y ON x.budget = y.budget AND x.regime = y.regime AND y.method = 'csp_lda'""")
def diff_from_primary(spark, d):
    from pyspark.sql import Window

    f = summary(spark, d).filter("regime <> 'population'").groupBy("method", "budget", "regime").agg(F.avg("roc_auc").alias("mean"))
    base = F.max(F.when(F.col("method") == "csp_lda", F.col("mean"))).over(Window.partitionBy("budget", "regime"))
    f = f.withColumn("diff_from_primary", F.col("mean") - base)
    return rounded(f.withColumn("direction", F.when(F.col("diff_from_primary") > 0, "higher").when(F.col("diff_from_primary") < 0, "lower").otherwise("same")))


RESAMPLES = 2000


@query(f"""WITH {PAIR}, v AS (SELECT method, budget, list(difference ORDER BY dataset || '::' || target_subject) AS v FROM d GROUP BY ALL),
 bm AS (SELECT method, budget, list_sum([v[1 + CAST(('0x' || substr(md5('{SEED}:' || b || ':' || i), 1, 8)) AS BIGINT) % len(v)] FOR i IN range(1, len(v) + 1)]) / len(v) AS m FROM v, (SELECT unnest(range(1, {RESAMPLES} + 1)) AS b) r)
SELECT method, budget, round(quantile_cont(m, 0.025), 6) + 0.0::DOUBLE AS ci_low, round(quantile_cont(m, 0.975), 6) + 0.0::DOUBLE AS ci_high FROM bm GROUP BY ALL""")
def bootstrap_hash_ci(spark, d):
    x = differences(spark, d).withColumn("id", F.concat_ws("::", "dataset", "target_subject"))
    return rounded(curves.hash_bootstrap(x, ["method", "budget"], "difference", "id", RESAMPLES, SEED))


TIMES_SQL = " + ".join(f"CAST(u >= {t!r} AS INTEGER)" for t in curves.TIMES)


@query(f"""WITH {PAIR}, vals AS (SELECT method, budget, difference AS v, dataset || '::' || target_subject AS id FROM d WHERE isfinite(difference)),
 digests AS (SELECT *, md5('{SEED}:' || id || ':' || ((b - 1) // 4)) AS h FROM vals, (SELECT unnest(range(1, {RESAMPLES} + 1)) AS b) x),
 drawn AS (SELECT method, budget, b, v, {TIMES_SQL} AS n FROM (SELECT *, CAST(('0x' || substr(h, 8 * ((b - 1) % 4)::INTEGER + 1, 8)) AS BIGINT) / 4294967296 AS u FROM digests)),
 means AS (SELECT method, budget, b, sum(n * v) / sum(n) AS m FROM drawn WHERE n > 0 GROUP BY ALL)
SELECT method, budget, round(quantile_cont(m, 0.025), 6) + 0.0::DOUBLE AS ci_low, round(quantile_cont(m, 0.975), 6) + 0.0::DOUBLE AS ci_high FROM means GROUP BY ALL""")
def merged_bootstrap_ci(spark, d):
    """Intervals whose resamples add up wherever rows are."""
    return rounded(curves.merged_bootstrap(differences(spark, d), ["method", "budget"], "difference", F.concat_ws("::", "dataset", "target_subject"), RESAMPLES, SEED))


@query(f"""WITH {PREDICTIONS}, r AS (SELECT method, y, s, avg(rn) OVER (PARTITION BY method, s) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY s) AS rn FROM (SELECT method, y, CASE WHEN s IN (0, 1) THEN s ELSE s + CAST(('0x' || substr(md5(trial_uid), 1, 8)) AS BIGINT) / 4294967296 / 1000 END AS s
 FROM (SELECT *, l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS trial_uid FROM j, (SELECT unnest(['csp_lda', 'riemann_lr', 'logvar_lda']) AS method) m1, LATERAL (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE method WHEN 'csp_lda' THEN l_discount * 10 WHEN 'riemann_lr' THEN l_quantity / 50 ELSE (l_discount * 10 + l_quantity / 50) / 2 END)) AS s) l)))),
 a AS (SELECT method, count(*) AS n, sum(y) AS n1, sum(rank * y) AS ranks FROM r GROUP BY ALL)
SELECT method, n AS n_trials, round((ranks - n1 * (n1 + 1) / 2) / (n1 * (n - n1)), 6) AS roc_auc FROM a""")
def huge_conditions(spark, d):
    """Three conditions of all rows each, with nearly as many distinct scores, ranked in ranges."""
    j = sources.table(spark, d, "lineitem").join(sources.table(spark, d, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    jitter = F.conv(F.substring(F.md5(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), 1, 8), 16, 10).cast("double") / float(1 << 32) / 1000
    scores = F.array(*[F.struct(F.lit(m).alias("method"), s.alias("s")) for m, s in (("csp_lda", F.col("l_discount") * 10), ("riemann_lr", F.col("l_quantity") / 50), ("logvar_lda", (F.col("l_discount") * 10 + F.col("l_quantity") / 50) / 2))])
    p = j.select((F.col("l_returnflag") == "R").cast("int").alias("y_true"), jitter.alias("jitter"), F.inline(scores))
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "s"))
    p = p.withColumn("y_score", F.when(s.isin(0.0, 1.0), s).otherwise(s + F.col("jitter")))
    return rounded(metrics.binary_metrics(p, ["method"], True).select("method", "n_trials", "roc_auc"))


@query("""SELECT CAST(rejected AS BOOLEAN) AS rejected, CAST(label AS INTEGER) AS label, count(*) AS n, min(length(text)) AS shortest FROM (SELECT lang NOT IN ('en', 'fr', 'de', 'es') OR lang IS NULL AS rejected, CASE WHEN lang IN ('en', 'de') THEN 1 WHEN lang IN ('fr', 'es') THEN 0 END AS label, text FROM documents) GROUP BY ALL""")
def label_encode(spark, d):
    """All rows, by two encoders of two labels each; what neither takes is counted as rejected."""
    t, lang = sources.table(spark, d, "documents"), F.lower(F.trim("lang"))
    label = F.when(lang.isin("en", "fr"), fn.encode_labels(F.col("lang"), "fr", "en")).when(lang.isin("de", "es"), fn.encode_labels(F.col("lang"), "es", "de"))
    t = t.select(label.alias("label"), "text").withColumn("rejected", F.col("label").isNull())
    return t.groupBy("rejected", "label").agg(F.count("*").alias("n"), F.min(F.length("text")).cast("long").alias("shortest"))


@query(f"""WITH {TRIALS}, u AS (SELECT DISTINCT dataset, subject FROM t), s AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY subject) - 1 AS number, count(*) OVER (PARTITION BY dataset) - 1 AS others FROM u),
 g AS (SELECT *, list_reduce(list_prepend([]::BIGINT[], [[i] FOR i IN range(greatest(others - {POOL}, 0), others)]), lambda had, one: list_append(had, CASE WHEN list_contains(had, CAST(('0x' || substr(md5('{SEED}:' || subject || ':' || one[1]), 1, 8)) AS BIGINT) % (one[1] + 1)) THEN one[1]
 ELSE CAST(('0x' || substr(md5('{SEED}:' || subject || ':' || one[1]), 1, 8)) AS BIGINT) % (one[1] + 1) END)) AS taken FROM s WHERE others > 0),
 x AS (SELECT dataset, subject AS target_subject, number AS own, unnest(taken) AS n, unnest(range(1, len(taken) + 1)) AS place FROM g)
SELECT x.dataset, x.target_subject, s.subject AS source_subject, CAST(x.place AS INTEGER) AS place FROM x JOIN s ON s.dataset = x.dataset AND s.number = x.n + CAST(x.n >= x.own AS INTEGER)""")
def source_subject_draw(spark, d):
    return assign.drawn_sources(sources.trials(spark, d), POOL, SEED)
