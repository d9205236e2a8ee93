"""The workflow of a configuration: prepare, validate, run, audit, aggregate, figures, robustness, and a smoke test of it all.

Every step reads and writes tables under the folders that the configuration's fingerprints name, so that a step can be run again, on another
cluster, and goes on where it stopped.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack import functions as fn
from tamarack import plans, provenance
from tamarack.config import Config, fingerprint
from tamarack.operators import assign, curves, metrics, mixed, published, report, reuse, runner, statistics
from tamarack.sources import METRICS, archive, files, results, shards

#: Fixed value: how aligned runs are marked.
ALIGNED = "euclidean_training_only"
EXPLORATORY = "post_confirmatory_exploratory_robustness"
CONDITION = ["dataset", "target_subject", "repeat", "method", "regime", "budget"]
REUSE = "assignment_reuse_report.json"
#: Targets that are fitted, and then written, at a time: what an interrupted run loses at most.
WAVE = 256


def aligned(c: Config) -> bool:
    return c["alignment"]["mode"] != "none"


def alignment_digest(c: Config) -> str:
    return fingerprint(c["alignment"], 64)


def prepare(spark: SparkSession, c: Config) -> list[str]:
    """Makes each dataset's trials by its adapter, or from the recordings in cache_root/<dataset>, saves those of new subjects, and writes its manifest. Gives the manifests' paths."""
    archive.register(spark)
    out, p = [], c["preprocessing"]
    for d in c["datasets"]:
        options = {k: str(v) for k, v in p.items() if v is not None and not isinstance(v, list)} | {"rate": str(p["resample"]), "seed": str(c["experiment"]["seed"]), "dataset": d["name"]}
        if p["channels"]:
            options["channels"] = str(len(p["channels"])) if d["name"] == "SyntheticMI" else ",".join(p["channels"])
        folder = f"{c['experiment']['cache_root']}/{d['name']}"
        chosen = shards.resolved(archive.available(spark, d["name"], folder, options), d["subjects"], d["exclude_subjects"])
        trials = archive.trials(spark, d["name"], folder, options, p, chosen)
        shards.save(trials, c.processed_dir, p, provenance.package_versions(), c["runtime"]["overwrite_processed"])
        shards.dataset_manifest(spark, c.processed_dir, d["name"], c.preprocessing_fingerprint)
        out.append(f"{c.processed_dir}/{d['name']}.manifest.json")
    return out


def validate_data(spark: SparkSession, c: Config, verify: bool = True) -> DataFrame:
    """One row a prepared subject; what differs from manifests or configuration raises."""
    found = [shards.validate_dataset(spark, c.processed_dir, d["name"], c.preprocessing_fingerprint, verify) for d in c["datasets"]]
    return plans.ordered(reduce(DataFrame.unionByName, found), "dataset", "subject")


def trials(spark: SparkSession, c: Config) -> DataFrame:
    """The trials of the configured subjects; fewer than two of a dataset raise."""
    found = []
    for d in c["datasets"]:
        chosen = shards.resolved(shards.prepared(spark, c.processed_dir, d["name"]), d["subjects"], d["exclude_subjects"], 2)
        found.append(shards.load(spark, c.processed_dir, d["name"], chosen))
    t = reduce(DataFrame.unionByName, found)
    if bad := shards.incompatible(t).collect():  # a row for each dataset
        raise ValueError(f"subjects differ in channels or samples: {[x.dataset for x in bad]}")
    return t


def dataset_digests(spark: SparkSession, c: Config) -> dict[str, str]:
    return {d["name"]: files.digest(spark, f"{c.processed_dir}/{d['name']}.manifest.json") for d in c["datasets"]}


def expected(split: DataFrame, c: Config) -> DataFrame:
    """The conditions to expect of the splits; aligned runs have neither a population nor a zero budget."""
    grid = assign.grid(split.select(*results.SPLIT).distinct(), c["methods"], c["calibration"]["budgets_per_class"])
    return grid.filter("budget > 0") if aligned(c) else grid


def metric_rows(fits: DataFrame, split: DataFrame, c: Config) -> DataFrame:
    """Stored metrics of fitted conditions: a row for each, ok with its six metrics, or failed with its error."""
    sizes = ["calibration_trials_total", "source_subject_count", "source_trials", "train_trials", "fit_seconds", "predict_seconds", "error", "error_type"]
    one = fits.groupBy(*CONDITION).agg(F.count("trial_uid").alias("test_trials"), *[F.max(x).alias(x) for x in sizes])
    scores = metrics.binary_metrics(fits.filter("error is null"), CONDITION).drop("n_trials")
    rows = one.join(scores, CONDITION, "left").join(split.select(*results.SPLIT, "split_strategy").distinct(), results.SPLIT[:3])
    whole = F.col("error").isNull() & F.col("roc_auc").isNotNull()
    zero = F.col("budget") == 0
    rows = rows.withColumns({
        "status": F.when(whole, "ok").otherwise("failed"), "error_message": F.when(~whole, F.coalesce("error", F.lit("a class is absent from the test trials"))), "error_type": F.when(~whole, F.coalesce("error_type", F.lit("ValueError"))),
        "condition_seed": fn.derive_seed(c["experiment"]["seed"], *[F.col(k) for k in CONDITION]), "duplicate_of_population": zero & (F.col("regime") == "source_plus_target"), "fit_shared_across_repeats": zero,
        **{m: F.when(whole, F.col(m)) for m in METRICS}, "alignment_mode": F.lit(c["alignment"]["mode"]),
    })
    return results.outside(rows)


def run(spark: SparkSession, c: Config, root: str = ".", source: str | None = None, estimators: dict | None = None) -> str:
    """Fits what the run's folder lacks of the configured conditions. source: the run whose assignments an aligned run takes up; they are held against
    a fresh assignment before anything is fitted. Gives the folder.

    Conditions that failed count as done. Predictions are written before their metrics; a condition with part of its predictions raises."""
    out, budgets, repeats = c.output_dir, c["calibration"]["budgets_per_class"], c["split"]["repeats"]
    if aligned(c) and not source:
        raise ValueError("an aligned run takes up the assignments of another run: name its folder")
    if not c["runtime"]["resume"] and any(results.exists(spark, out, n) for n in results.TABLES):
        raise FileExistsError(f"{out} has results, and the configuration does not resume")
    t = trials(spark, c)
    draws = published if c["draws"]["stream"] == "numpy" else assign
    tables = draws.tables(t, c["experiment"]["seed"], c["split"], c["calibration"], c["source"])
    tables = {n: results.shaped(df, n).cache() for n, df in tables.items()}
    more = {}
    if aligned(c):
        taken = reuse.load(spark, source)
        report_ = {"status": "ok"} | taken.report() | {"regeneration_equality_gate": reuse.verified(taken.tables, tables)}
        files.write_json(spark, f"{out}/{REUSE}", report_)
        more, tables = {"ea_assignment_reuse": taken.report()}, taken.tables
    provenance.started(spark, c, root, dataset_manifest_sha256=dataset_digests(spark, c), **more)
    if not aligned(c):
        for name, by in (("split_assignments", results.SPLIT), ("calibration_assignments", results.SPLIT), ("source_selection", results.SPLIT[:2]), ("source_trial_assignments", results.SPLIT[:2])):
            results.append(tables[name], out, name, by)
    split = tables["split_assignments"]
    done = results.inside(results.read_or_empty(spark, out, "metrics", aligned(c))).select(*CONDITION)
    left = expected(split, c).join(done, CONDITION, "left_anti")
    open_ = left.select("dataset", "target_subject").distinct().withColumn("wave", F.floor((F.row_number().over(Window.orderBy("dataset", "target_subject")) - 1) / WAVE)).cache()  # keys only
    own = [x for x in budgets if x] if aligned(c) else budgets
    for (wave,) in open_.select("wave").distinct().orderBy("wave").collect():  # a row for each wave
        now = open_.filter(F.col("wave") == wave).drop("wave")
        grid = runner.assigned(t, split, tables["calibration_assignments"], tables["source_trial_assignments"], repeats).join(now, ["dataset", "target_subject"], "left_semi")
        fits = runner.fitted(grid, c["methods"], own, repeats, aligned(c), estimators).join(left.select(*CONDITION), CONDITION, "left_semi")
        _kept(spark, c, out, fits, split)
        if aligned(c):
            _provenance(grid, tables, c, out)
    failed = results.read(spark, out, "metrics", aligned(c)).filter("status <> 'ok'")
    if not c["experiment"]["continue_on_error"] and (x := failed.limit(5).collect()):
        raise RuntimeError(f"conditions failed: {[(r.dataset, r.target_subject, r.method, r.error_message) for r in x]}")
    return out


def _kept(spark: SparkSession, c: Config, out: str, fits: DataFrame, split: DataFrame) -> None:
    """Writes a wave's predictions and failures, then its metrics, after which its conditions count as done. Each table takes a condition once, so that a wave that broke off
    between them is written again without harm."""
    staged = f"{out}/.fits"
    fits.write.mode("overwrite").parquet(staged)  # fitted once, read by all that follows
    fits = spark.read.parquet(staged)
    of_trial = split.select(*results.SPLIT, "trial_uid", "session", "run", "split_strategy")
    if c["runtime"]["save_predictions"]:
        p = fits.filter("error is null").join(of_trial, [*results.SPLIT[:3], "trial_uid"]).withColumns({"condition_seed": fn.derive_seed(c["experiment"]["seed"], *[F.col(k) for k in CONDITION]), "alignment_mode": F.lit(c["alignment"]["mode"])})
        results.append(results.outside(p), out, "predictions", results.CONDITION, aligned(c))
    bad = results.outside(fits.filter("error is not null").withColumn("error_message", F.col("error"))).join(split.select(*results.SPLIT).distinct(), results.SPLIT[:3])
    results.append(bad, out, "failures", results.CONDITION)
    results.append(metric_rows(fits, split, c), out, "metrics", results.CONDITION, aligned(c))
    files.remove(spark, staged)


def _provenance(grid: DataFrame, tables: dict[str, DataFrame], c: Config, out: str) -> None:
    """What each alignment was made from."""
    made = runner.references(grid, c["calibration"]["budgets_per_class"], c["split"]["repeats"]).withColumn("alignment_config_digest", F.lit(alignment_digest(c))).cache()
    seeds = tables["source_selection"].select("dataset", "target_subject", "source_subject", "selection_seed")
    s = made.filter("part = 'source'").select("dataset", "target_subject", F.col("subject").alias("source_subject"), F.col("trials").alias("source_trial_count"), F.col("reference").alias("source_alignment_reference_sha256"), "alignment_config_digest")
    results.append(s.join(seeds, ["dataset", "target_subject", "source_subject"]), out, "source_alignment_provenance", ["dataset", "target_subject", "source_subject"])
    g = made.filter("part = 'target'").select("dataset", "target_subject", "repeat", F.col("budget").alias("budget_per_class"), F.col("trials").alias("target_calibration_trial_count"), F.col("uids").alias("target_calibration_trial_uid_sha256"), F.col("reference").alias("target_alignment_reference_sha256"), "alignment_config_digest")
    results.append(g.join(tables["split_assignments"].select(*results.SPLIT).distinct(), results.SPLIT[:3]), out, "target_alignment_provenance", [*results.SPLIT, "budget_per_class"])


def audit_rules(spark: SparkSession, c: Config) -> dict[str, DataFrame]:
    """All rules that a run's tables must keep, as the rows that break them."""
    out, own = c.output_dir, aligned(c)
    m = results.read(spark, out, "metrics", own)
    ok = results.inside(m.filter("status = 'ok'"))
    keys = [*CONDITION, "split_id"]
    rules = plans.metric_rules(ok, keys, METRICS) | plans.protocol_rules(m.filter("status = 'ok'")) | {"some_success": ok.agg(F.count("*").alias("n")).filter("n = 0")}
    folder = files.read_json(spark, f"{out}/{provenance.MANIFEST}")["ea_assignment_reuse"]["primary_output_dir"] if own else out
    tables = {n: results.read(spark, folder, n) for n in results.ASSIGNMENTS}
    split, calibration, selection, detail = (tables[n] for n in results.ASSIGNMENTS)
    rules |= plans.stored_assignment_rules(split, calibration, c["calibration"]["budgets_per_class"])
    s = c["source"]
    rules |= plans.detail_rules(selection, detail, s["max_subjects"], s["max_trials_per_class_per_subject"], s["balance_classes_within_subject"])
    want = expected(split, c).select(*keys)
    rules["grid"] = plans.grid_difference(want, results.inside(m), keys)
    if c["runtime"]["save_predictions"]:
        p = results.inside(results.read(spark, out, "predictions", own))
        again = metrics.binary_metrics(p, keys)
        test = split.filter("role = 'test'")
        rules |= plans.prediction_rules(p, keys) | {
            "prediction_counts": plans.miscounted(ok.withColumn("n_trials", F.col("test_trials").cast("long")), p, keys), "recomputed": plans.recomputed(ok, again, keys, METRICS),
            "unique_predictions": plans.duplicates(p, [*keys, "trial_uid"]), "test_trials": plans.unlike(p, test, [*results.SPLIT, "trial_uid"]),
        }
        zero = lambda regime: p.filter((F.col("regime") == regime) & (F.col("budget") == 0))
        rules["zero_budget_copy"] = plans.unlike_scores(zero("population"), zero("source_plus_target"), ["dataset", "target_subject", "repeat", "method", "split_id", "trial_uid"])
    if own:
        n = want.count()
        p = results.read(spark, out, "predictions", own) if c["runtime"]["save_predictions"] else results.read_or_empty(spark, out, "predictions", own)
        source, target = (results.read(spark, out, f"{x}_alignment_provenance") for x in ("source", "target"))
        rules |= {f"aligned_{k}": v for k, v in plans.aligned_rules(m, p, source, target, ALIGNED, n).items()}
    return rules


def audit(spark: SparkSession, c: Config) -> dict:
    """status, and what was counted; what breaks a rule, or keeps the audit from being made, is reported and does not raise."""
    try:
        rules = audit_rules(spark, c)
        found = plans.audit(rules).cache()
        said = plans.status(found).first().asDict()
        if said["status"] != "ok":
            bad = {r.rule: rules[r.rule] for r in found.filter("n_violations > 0").collect()}  # a row for each rule
            return said | {"examples": [tuple(r) for r in plans.examples(bad).collect()]}
        if aligned(c):
            gate = files.read_json(spark, f"{c.output_dir}/{REUSE}")
            if gate.get("status") != "ok" or (gate.get("regeneration_equality_gate") or {}).get("status") != "ok":
                raise ValueError(f"the assignments were not verified: {gate}")
        m = results.read(spark, c.output_dir, "metrics", aligned(c))
        counts = m.agg(F.count_if(F.col("status") == "ok").alias("successful_conditions"), F.count_if(F.col("status") != "ok").alias("failed_conditions"), F.countDistinct("dataset", "target_subject").alias("participants")).first().asDict()
        return {"status": "ok", "rules": len(rules), "metrics_checked": METRICS} | counts | ({"classification": EXPLORATORY} if aligned(c) else {})
    except Exception as e:  # an audit reports
        return {"status": "failed", "error_type": type(e).__name__, "error_message": str(e).split("\n")[0]}


def flow(m: DataFrame, s: DataFrame) -> DataFrame:
    """By dataset: participants tried, with any success, with any failure, rows of either, and summary rows."""
    ok = F.col("status") == "ok"
    people = lambda x: F.countDistinct(F.when(x, F.col("target_subject")))
    g = m.groupBy("dataset").agg(
        F.countDistinct("target_subject").alias("participants_attempted"), people(ok).alias("participants_with_any_success"), people(~ok).alias("participants_with_any_failure"),
        F.count_if(ok).alias("successful_condition_rows"), F.count_if(~ok).alias("failed_condition_rows"),
    )
    return g.join(s.groupBy("dataset").agg(F.count("*").alias("participant_condition_summaries")), "dataset", "left").fillna(0, ["participant_condition_summaries"])


def areas_of(s: DataFrame, c: Config) -> DataFrame:
    """Areas, slopes and first budgets for each metric's curves: aucc_<metric>, slope_<metric>, and budgets that reach the configured thresholds."""
    a, keys = c["analysis"], ["dataset", "target_subject", "method", "regime"]
    horizon = a["aucc_max_budget_per_class"]
    want = [b for b in c["calibration"]["budgets_per_class"] if b <= horizon]
    least = {"roc_auc": a["roc_auc_threshold"], "balanced_accuracy": a["balanced_accuracy_threshold"]}
    out = None
    for m in METRICS:
        own = curves.aucc(s, m, want, horizon, least.get(m, 2.0))
        first = [F.col("first_budget").alias(f"first_budget_{m}")] if m in least else []
        new = own.select(*keys, F.col("aucc").alias(f"aucc_{m}"), F.col("slope").alias(f"slope_{m}"), *first)
        out = own.select(*keys, "observed_budgets", "curve_complete", "reason").join(new, keys) if out is None else out.join(new, keys)
    return out


def curve_table(s: DataFrame, c: Config) -> DataFrame:
    """Curves with seeded intervals, by dataset, method, regime, budget and metric."""
    from tamarack.operators import bootstrap

    keys, a = ["dataset", "method", "regime", "budget", "metric"], c["analysis"]
    long = s.unpivot(["dataset", "target_subject", "method", "regime", "budget"], METRICS, "metric", "value").dropna(subset=["value"])
    ci = bootstrap.intervals(long, keys, "value", a["bootstrap_resamples"], a["ci_level"], bootstrap.curve_seed(c["experiment"]["seed"]))
    return curves.curve_long(s).join(ci.drop("estimate", "n_values"), keys)


def aggregate(spark: SparkSession, c: Config) -> str:
    """Audits the run, which raises if a rule is broken, then writes its summaries, curves, areas, tests, model and flow, and a manifest. Aligned runs
    have no areas and no model, and nothing of theirs is called confirmatory."""
    out, own = c.output_dir, aligned(c)
    said = audit(spark, c)
    if said["status"] != "ok":
        raise ValueError(f"the audit failed: {said}")
    m = results.inside(results.read(spark, out, "metrics", own)).cache()
    s = curves.repeat_average(m).cache()
    primary, made = c["metrics"]["primary"], {"summary_subject": plans.ordered(results.outside(s), "dataset", "target_subject", "method", "regime", "budget_per_class"), "curve_summary": curve_table(s, c)}
    texts = {"result_audit.json": said}
    if own:
        made["pairwise_tests"] = statistics.relabelled(statistics.contrasts(s, None, c), statistics.ALIGNED, "exploratory", EXPLORATORY)
        made["ea_regime_contrast_trajectory"] = statistics.trajectory(s, c).withColumn("classification", F.lit(EXPLORATORY))
    else:
        made["aucc_subject"] = areas_of(s, c)
        areas = made["aucc_subject"].withColumn("aucc", F.col(f"aucc_{primary}"))
        made["pairwise_tests"] = statistics.contrasts(s, areas if {"csp_lda", "riemann_lr"} <= set(c["methods"]) else None, c)
        diagnostics = {"status": "not_run", "metric": primary, "reason": "analysis.fit_mixed_effects is false"}
        terms = spark.createDataFrame([], "term string, estimate double, se double, model string")
        if c["analysis"]["fit_mixed_effects"]:
            terms = mixed.terms(s, primary, c["methods"], ["subject", "source_plus_target"]).cache()
            diagnostics = {"status": "not_estimated" if terms.filter("term = 'not_estimated'").count() else "ok", "metric": primary, "model": terms.first().model}
        made["mixed_effects_coefficients"], texts["mixed_effects_diagnostics.json"] = terms, diagnostics
    made["participant_flow"] = flow(m, s)
    for name, df in made.items():
        files.replace_table(df, f"{out}/{name}.csv")
    for name, value in texts.items():
        files.write_json(spark, f"{out}/{name}", value)
    more = {"classification": EXPLORATORY} if own else {}
    files.write_json(spark, f"{out}/aggregation_manifest.json", provenance.outputs(spark, out, [*[f"{n}.csv" for n in made], *texts], experiment_fingerprint=c.experiment_fingerprint, input_metrics_sha256=files.digest(spark, f"{out}/metrics"), **more))
    return out


SUMMARY = "dataset string, target_subject string, method string, regime string, budget_per_class int, " + ", ".join(f"{m} double" for m in METRICS)


def aggregated(spark: SparkSession, c: Config, name: str) -> DataFrame:
    """A table that aggregate wrote."""
    path = f"{c.output_dir}/{name}.csv"
    if not files.exists(spark, path):
        raise FileNotFoundError(f"{path}: aggregate the run first")
    text = ("dataset", "target_subject", "method", "regime", "metric", "term", "model", "family", "inference_role", "scope_dataset", "contrast", "method_left", "method_right", "scope_weighting", "observed_budgets", "reason", "classification")
    raw = spark.read.option("header", True).csv(path)
    kind = lambda x: "string" if x in text else "int" if x in ("budget", "budget_per_class") else "boolean" if x == "curve_complete" else "double"
    return results.inside(raw.select(*[F.col(x).cast(kind(x)).alias(x) for x in raw.columns]))


def figures(spark: SparkSession, c: Config) -> str:
    """The rows that figures show, as tables, with a manifest of checksums. Aligned runs have curves and heterogeneity only."""
    out, primary = f"{c.output_dir}/figures", c["metrics"]["primary"]
    curve, s = aggregated(spark, c, "curve_summary"), aggregated(spark, c, "summary_subject")
    made = {f"calibration_curve_{fn_safe(m)}": report.curve_panels(curve, m) for m in (primary, *c["metrics"]["secondary"])}
    budgets = [b for b in c["calibration"]["budgets_per_class"] if b]
    made["heterogeneity"] = s.filter("budget > 0").groupBy("dataset", "target_subject", "method", "regime").pivot("budget", budgets).agg(F.max(primary))
    if not aligned(c):
        a = aggregated(spark, c, "aucc_subject").filter("curve_complete")
        x = F.col(f"aucc_{primary}")
        made["aucc_box"] = a.groupBy("method", "regime").agg(F.min(x).alias("low"), F.percentile(x, F.lit(0.25)).alias("q1"), F.median(x).alias("mid"), F.percentile(x, F.lit(0.75)).alias("q3"), F.max(x).alias("high"))
    for name, df in made.items():
        files.replace_table(df, f"{out}/{name}.csv")
    files.write_json(spark, f"{out}/figure_manifest.json", provenance.outputs(spark, out, [f"{n}.csv" for n in made], experiment_fingerprint=c.experiment_fingerprint))
    return out


def fn_safe(name: str) -> str:
    return name.replace("/", "-").replace(" ", "_")


def tables(spark: SparkSession, c: Config) -> str:
    """Publication tables of an aggregated run, as CSV, LaTeX and Markdown."""
    out = f"{c.output_dir}/tables"
    t, terms = aggregated(spark, c, "pairwise_tests"), aggregated(spark, c, "mixed_effects_coefficients")
    tests = {"contrast": "Contrast", "budget_or_regime": "Condition", "method_display": "Method", "n_pairs": "$n$", "mean": "Mean", "ci_lower": "Lower", "ci_upper": "Upper", "p_holm": "Holm $p$", "rank_biserial": "$r$"}
    model = {"term_label": "Term", "estimate": "Estimate", "se": "SE", "z": "$z$"}
    made = {
        "table2_contrasts": (plans.ordered(report.main_contrasts(t), "family", "method_display", "budget"), tests, "Main contrasts, pooled over datasets."),
        "supplement_contrasts": (plans.ordered(report.supportive_contrasts(t), "family", "scope_dataset", "budget_or_regime", "method_display"), {"scope_dataset": "Dataset"} | tests, "Contrasts within each dataset."),
        "table3_model": (report.fixed_effects(terms, True), model, "Mixed model: main terms."), "table3_full": (report.fixed_effects(terms), model, "Mixed model: all fixed effects."),
        "table3_variance": (report.variance_components(terms), {"term": "Component", "estimate": "Estimate"}, "Mixed model: variance components."),
        "table1_cohort": (aggregated_flow(spark, c), {"dataset": "Dataset", "participants_attempted": "Attempted", "participants_with_any_success": "Analysed"}, "Datasets and participants."),
    }
    for name, (df, columns, caption) in made.items():
        files.replace_table(df, f"{out}/{name}.csv")
        files.write_text(spark, f"{out}/{name}.tex", report.latex(df, columns, caption, f"tab:{name}"))
        files.write_text(spark, f"{out}/{name}.md", report.markdown(df, columns))
    files.write_json(spark, f"{out}/table_manifest.json", provenance.outputs(spark, out, [f"{n}.{e}" for n in made for e in ("csv", "tex", "md")], experiment_fingerprint=c.experiment_fingerprint))
    return out


def aggregated_flow(spark: SparkSession, c: Config) -> DataFrame:
    own = aggregated(spark, c, "participant_flow")
    return own.select("dataset", *[F.col(x).cast("int").alias(x) for x in own.columns if x != "dataset"])


def robustness(spark: SparkSession, c: Config, dataset: str, participants: int | None = None) -> str:
    """Tests without one dataset, the mixed model with random intercepts only beside the primary one, and who benefits; with a manifest. participants: how
    many must be left without the dataset."""
    out, primary = f"{c.output_dir}/robustness", c["metrics"]["primary"]
    s, a = aggregated(spark, c, "summary_subject").withColumn("log2_budget", F.log2(F.col("budget") + 1)).cache(), aggregated(spark, c, "aucc_subject").withColumn("aucc", F.col(f"aucc_{primary}"))
    rest, areas = statistics.without(s, dataset).cache(), statistics.without(a, dataset)
    left = rest.select("dataset", "target_subject").distinct().count()
    if participants is not None and left != participants:  # none left included
        raise ValueError(f"participants left: {left}")
    tests = statistics.relabelled(statistics.contrasts(rest, areas, c), statistics.WITHOUT, statistics.WITHOUT_ROLES, "post_confirmatory_robustness_without_dataset")
    terms = mixed.terms(s, primary, c["methods"], ["subject", "source_plus_target"], slopes=False).withColumn("classification", F.lit("model_form_robustness_random_intercept_only")).cache()
    d = curves.paired(s.filter("budget > 0"), "regime", "subject", "source_plus_target", ["method", "budget", "dataset", "target_subject"], primary)
    both = d.withColumn("scope_dataset", F.explode(F.array(F.lit("ALL"), F.col("dataset"))))
    made = {
        "without_dataset_pairwise_tests": tests, "random_intercept_only_coefficients": terms, "mixed_model_structure_comparison": plans.ordered(statistics.structures(aggregated(spark, c, "mixed_effects_coefficients"), terms), "term"),
        "fraction_benefiting": plans.ordered(curves.benefit(both, ["method", "budget", "scope_dataset"]), "method", "budget", "scope_dataset"),
    }
    for name, df in made.items():
        files.replace_table(df, f"{out}/{name}.csv")
    files.write_json(spark, f"{out}/robustness_manifest.json", provenance.outputs(spark, out, [f"{n}.csv" for n in made], source_dir=c.output_dir, without=dataset, participants_left=left, input_sha256={n: files.digest(spark, f"{c.output_dir}/{n}.csv") for n in ("summary_subject", "aucc_subject", "mixed_effects_coefficients")}))
    return out


def compare(spark: SparkSession, primary: Config, other: Config, out: str) -> str:
    """The pooled contrasts of an aligned run beside the primary run's, and both trajectories."""
    t, u = (aggregated(spark, x, "pairwise_tests") for x in (primary, other))
    one, two = (x.filter((F.col("family") == f) & F.col("budget").isNotNull()).withColumnRenamed("method_left", "method") for x, f in ((t, "regime_confirmatory"), (u, statistics.ALIGNED["regime_confirmatory"])))
    own = lambda d, n: d.select("method", "budget", *[F.col(x).alias(f"{x}_{n}") for x in ("ci_lower", "ci_upper", "p_holm")], statistics.excludes_zero(F.col("ci_lower"), F.col("ci_upper")).alias(f"ci_excludes_zero_{n}"))
    both = statistics.cross_run(one, two, ["method", "budget"], "mean").join(own(one, "primary"), ["method", "budget"], "left").join(own(two, "other"), ["method", "budget"], "left")
    files.replace_table(plans.ordered(both, "method", "budget"), f"{out}/contrast_comparison.csv")
    pooled = aggregated(spark, other, "ea_regime_contrast_trajectory").filter("scope_dataset = 'ALL'")
    files.replace_table(plans.ordered(statistics.trajectories(primary_unaligned=one, aligned_sensitivity=pooled), "method", "budget", "source"), f"{out}/trajectory_comparison.csv")
    files.write_json(spark, f"{out}/comparison_manifest.json", provenance.outputs(spark, out, ["contrast_comparison.csv", "trajectory_comparison.csv"], primary=primary.output_dir, other=other.output_dir))
    return out


def smoke_config(workspace: str, name: str) -> Config:
    """A small run over synthetic trials."""
    return Config({
        "experiment": {"name": "synthetic-smoke", "seed": 20260811, "output_root": f"{workspace}/{name}/results", "processed_root": f"{workspace}/data/processed", "cache_root": f"{workspace}/data/cache"},
        "preprocessing": {"fmax": 35.0, "tmin": 0.0, "tmax": 1.0, "channels": ["C3", "Cz", "C4"]}, "datasets": [{"name": "SyntheticMI", "subjects": [1, 2, 3]}],
        "split": {"test_fraction": 0.5, "repeats": 2, "minimum_test_per_class": 5, "minimum_calibration_per_class": 5}, "calibration": {"budgets_per_class": [0, 3, 5]},
        "analysis": {"bootstrap_resamples": 200, "pairwise_budgets": [3, 5], "aucc_max_budget_per_class": 5, "fit_mixed_effects": False}, "classical": {"csp_components": 3},
    })


def write_config(spark: SparkSession, c: Config, path: str) -> str:
    import yaml

    files.write_text(spark, path, yaml.safe_dump(json.loads(json.dumps(c.values)), sort_keys=False))
    return path


def negative_control(t: DataFrame, seed: int, permutations: int = 16, target: str = "1") -> dict:
    """The area under the curve where sources' labels are dealt anew among their trials, over so many seeded deals: mean, least and greatest. Each deal is a dataset of its
    own, so that deals are fitted side by side; the target is tested on its last session."""
    t = t.select("subject", "session", "trial_uid", "label", "x").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1)))).withColumn("dataset", F.col("deal").cast("string"))
    source, own = t.filter(F.col("subject") != target), t.filter(F.col("subject") == target)
    by = lambda *order: F.row_number().over(Window.partitionBy("dataset").orderBy(*order))
    dealt = source.select("dataset", "label", by(F.md5(F.concat_ws(":", F.lit(str(seed)), "deal", "trial_uid"))).alias("place"))
    source = source.drop("label").withColumn("place", by("trial_uid")).join(dealt, ["dataset", "place"])
    trials_ = source.select("dataset", "subject", "trial_uid", "label", "x").unionByName(own.select("dataset", "subject", "trial_uid", "label", "x"))
    last = F.col("session") == F.max("session").over(Window.partitionBy("dataset"))
    split = own.withColumn("last", last).filter("last").select("dataset", F.col("subject").alias("target_subject"), "trial_uid", F.lit(0).alias("repeat"), F.lit("test").alias("role"))
    none = t.sparkSession.createDataFrame([], "dataset string, target_subject string, trial_uid string, repeat int, budget_per_class int")
    picked = source.select("dataset", F.lit(target).alias("target_subject"), F.col("subject").alias("source_subject"), "trial_uid")
    scores = runner.fitted(runner.assigned(trials_, split, none, picked, 1), ["logvar_lda"], [0], 1).filter("regime = 'population'")
    m = metrics.binary_metrics(scores, ["dataset"])
    found = m.agg(F.avg("roc_auc").alias("mean_shuffled_label_roc_auc"), F.min("roc_auc").alias("minimum_shuffled_label_roc_auc"), F.max("roc_auc").alias("maximum_shuffled_label_roc_auc"), F.count("roc_auc").alias("n_permutations"))
    return found.first().asDict()


MARKER = ".tamarack-smoke-workspace"


def smoke(spark: SparkSession, workspace: str, clean: bool = True, with_figures: bool = True) -> dict:
    """Two equal runs over synthetic trials, which must agree in all but their timings; their audits; and a control with permuted labels."""
    if files.exists(spark, workspace) and clean:
        if not files.exists(spark, f"{workspace}/{MARKER}"):
            raise ValueError(f"{workspace} is no workspace of a smoke test, and is not deleted")
        files.remove(spark, workspace)
    files.write_text(spark, f"{workspace}/{MARKER}", "A smoke test may delete this folder.\n")
    a, b = (smoke_config(workspace, n) for n in ("run-a", "run-b"))
    for c, n in ((a, "a"), (b, "b")):
        write_config(spark, c, f"{workspace}/synthetic_smoke_{n}.yaml")
    prepare(spark, a)
    for c in (a, b):
        run(spark, c)
        aggregate(spark, c)
    if with_figures:
        figures(spark, a)
    rules = {"metrics": plans.unlike_runs(*(results.read(spark, c.output_dir, "metrics") for c in (a, b)))}
    rules |= {n: plans.unequal(*(results.read(spark, c.output_dir, n) for c in (a, b))) for n in results.ASSIGNMENTS}
    plans.gate(plans.audit(rules))
    said = {n: files.read_json(spark, f"{c.output_dir}/result_audit.json") for n, c in (("audit_a", a), ("audit_b", b))}
    control = negative_control(trials(spark, a), a["experiment"]["seed"])
    if not 0.3 <= control["mean_shuffled_label_roc_auc"] <= 0.7:
        raise AssertionError(f"permuted labels are told apart: {control}")
    ok = results.read(spark, a.output_dir, "metrics").filter("status = 'ok'").count()
    out = {"status": "ok", "synthetic_only": True, "deterministic_metrics_match": True, "run_a": a.output_dir, "run_b": b.output_dir, "negative_control": control, "successful_metric_rows": ok} | said
    files.write_json(spark, f"{workspace}/smoke_report.json", out)
    return out
