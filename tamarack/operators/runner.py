"""Fits and predictions of a condition grid: one task for each dataset, target and method, so that features load once."""

from __future__ import annotations

import time
import traceback

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.operators import assign, kernels

PREDICTION = (
    "dataset string, target_subject string, repeat int, method string, regime string, budget int, trial_uid string, y_true int, y_score double, y_pred int, error string, "
    "error_type string, traceback string, calibration_trials_total int, source_subject_count int, source_trials int, train_trials int, fit_seconds double, predict_seconds double"
)


def no_target() -> list[Column]:
    return [F.lit(None).cast("array<boolean>").alias("tested"), F.lit(None).cast("array<int>").alias("chosen")]


def by_repeat(repeats: int, of: Column) -> Column:
    """An array of what the map `of` has for each repeat."""
    return F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda r: of[r])


def assigned(trials: DataFrame, split: DataFrame, calibration: DataFrame, source: DataFrame, repeats: int) -> DataFrame:
    """As inputs, from tables of assignments. Rows meet trials by dataset, subject and trial id; an id that no trial has raises."""
    roles = split.groupBy("dataset", "target_subject", "trial_uid").agg(F.map_from_entries(F.collect_list(F.struct("repeat", (F.col("role") == "test").alias("t")))).alias("roles"))  # an entry a repeat
    least = calibration.groupBy("dataset", "target_subject", "trial_uid", "repeat").agg(F.min("budget_per_class").alias("b"))
    least = least.groupBy("dataset", "target_subject", "trial_uid").agg(F.map_from_entries(F.collect_list(F.struct("repeat", "b"))).alias("least"))
    target = roles.join(least, ["dataset", "target_subject", "trial_uid"], "left").select("dataset", "target_subject", F.lit("target").alias("part"), F.col("target_subject").alias("subject"), "trial_uid", by_repeat(repeats, F.col("roles")).alias("tested"), by_repeat(repeats, F.col("least")).alias("chosen"))
    target = target.filter(F.exists("tested", lambda t: t) | F.exists("chosen", lambda b: b.isNotNull()))
    own = source.select("dataset", "target_subject", F.lit("source").alias("part"), F.col("source_subject").alias("subject"), "trial_uid", *no_target())
    found = target.unionByName(own).join(trials.select("dataset", "subject", "trial_uid", "label", "x"), ["dataset", "subject", "trial_uid"], "left")
    known = F.when(F.col("label").isNull(), F.raise_error(F.concat(F.lit("no trial has the assigned id "), "trial_uid")).cast("int")).otherwise(F.col("label"))
    return found.withColumn("label", known)


def samples(pool: DataFrame, budgets: list[int], repeats: int, seed: int) -> DataFrame:
    """Nested calibration samples of each repeat, each by its own seed."""
    found = [assign.nested(pool, budgets, seed + r).withColumn("repeat", F.lit(r)) for r in range(repeats)]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


def inputs(trials: DataFrame, budgets: list[int], repeats: int, seed: int, most: int, cap: int) -> DataFrame:
    """dataset, target_subject, part (source, target), subject, trial_uid, label, x, tested, chosen: what each target's conditions need.

    tested: whether it is a test trial, by repeat. chosen: the least budget of each repeat that takes a pool trial, null where none does. Only keys
    are shuffled before epochs join them once."""
    split = assign.latest_session(trials.drop("x"))
    first = samples(split.filter("role = 'calibration_pool'"), budgets, repeats, seed).groupBy("dataset", "subject", "trial_uid", "repeat").agg(F.min("budget").alias("b"))
    per = first.groupBy("dataset", "subject", "trial_uid").agg(F.map_from_entries(F.collect_list(F.struct("repeat", "b"))).alias("m"))  # at most an entry a repeat
    chosen = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda r: F.col("m")[r])
    target = split.join(per, ["dataset", "subject", "trial_uid"], "left").filter("role = 'test' or m is not null")
    tested = F.array_repeat(F.col("role") == "test", repeats)
    target = target.select("dataset", F.col("subject").alias("target_subject"), F.lit("target").alias("part"), "subject", "trial_uid", tested.alias("tested"), chosen.alias("chosen"))
    pairs = assign.sources(trials, most, seed).select("dataset", "target_subject", F.col("source_subject").alias("subject"))
    source = pairs.join(assign.balanced(trials.drop("x"), cap, seed), ["dataset", "subject"]).select("dataset", "target_subject", F.lit("source").alias("part"), "subject", "trial_uid", *no_target())
    keys = target.unionByName(source.join(target.select("dataset", "target_subject").distinct(), ["dataset", "target_subject"], "left_semi"))
    return keys.join(trials.select("dataset", "subject", "trial_uid", "label", "x"), ["dataset", "subject", "trial_uid"])


def run(trials: DataFrame, methods: list[str], budgets: list[int], repeats: int, seed: int, most: int = 10, cap: int = 20, aligned: bool = False) -> DataFrame:
    """Predictions of every condition of a fresh assignment. trials: dataset, subject, session, trial_uid, label, x."""
    return fitted(inputs(trials, budgets, repeats, seed, most, cap), methods, budgets, repeats, aligned)


def fitted(grid: DataFrame, methods: list[str], budgets: list[int], repeats: int, aligned: bool = False, estimators: dict | None = None) -> DataFrame:
    """Predictions of every condition of a grid (inputs, assigned), with sizes and seconds.

    Methods are fitted one after another in a target's task, so that its epochs are shuffled once. A condition without an estimate has one row, with its
    error. A population fit serves both zero-budget regimes of all repeats whose test trials are the same.
    aligned: each subject's epochs are first whitened by its own training trials' mean covariance; a target without any takes its sources' mean."""
    positive, known = [b for b in budgets if b], kernels.ESTIMATORS if estimators is None else estimators

    def fit(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["part", "subject", "trial_uid"])
        x, y = np.array([np.stack(v) for v in d["x"]], np.float64), d["label"].to_numpy(int)
        part, subject, uid = d["part"].to_numpy(), d["subject"].to_numpy(), d["trial_uid"].to_numpy()
        source, own = np.flatnonzero(part == "source"), np.flatnonzero(part == "target")
        first, tested, out = np.full((len(d), repeats), np.inf), np.zeros((len(d), repeats), bool), []
        for k in own:
            tested[k] = [bool(v) for v in d["tested"].iloc[k]]
            chosen = d["chosen"].iloc[k]
            if chosen is not None:
                first[k] = [np.inf if v is None or np.isnan(v) else v for v in np.array(chosen, float)]
        base = x
        if aligned:
            base = x.copy()
            for s in np.unique(subject[source]):
                at = source[subject[source] == s]
                base[at] = kernels.alignment(x[at]) @ x[at]

        def scores(method: str, train: np.ndarray, mine: np.ndarray, test: np.ndarray) -> dict:
            start = time.perf_counter()
            try:
                seen = base
                if aligned:
                    white = kernels.alignment(x[mine] if len(mine) else x[source])
                    seen = base.copy()
                    at = np.concatenate([mine, test]).astype(int)
                    seen[at] = white @ x[at]
                model = known[method]().fit(*kernels.checked(seen[train], y[train]))
                middle = time.perf_counter()
                p = model.score(seen[test])
                if not np.isfinite(p).all() or ((p < 0) | (p > 1)).any():
                    raise ValueError("scores are not probabilities")
                return {"p": p, "fit_seconds": middle - start, "predict_seconds": time.perf_counter() - middle}
            except (ValueError, np.linalg.LinAlgError) as e:
                return {"p": None, "error": str(e), "error_type": type(e).__name__, "traceback": traceback.format_exc()}

        def add(method: str, r: int, regime: str, budget: int, test: np.ndarray, got: dict, train: np.ndarray, shared: bool = False) -> None:
            p = got["p"]
            many = regime != "subject"
            out.append(pd.DataFrame({
                "dataset": d["dataset"].iloc[0], "target_subject": d["target_subject"].iloc[0], "repeat": r, "method": method, "regime": regime, "budget": budget,
                "trial_uid": uid[test] if p is not None else [None], "y_true": pd.array(y[test] if p is not None else [None], "Int32"),
                "y_score": p if p is not None else [None], "y_pred": pd.array((p >= 0.5).astype(int) if p is not None else [None], "Int32"),
                "error": got.get("error"), "error_type": got.get("error_type"), "traceback": got.get("traceback"), "calibration_trials_total": 2 * budget,
                "source_subject_count": len(np.unique(subject[source])) if many else 0, "source_trials": len(source) if many else 0, "train_trials": len(train),
                "fit_seconds": 0.0 if shared else got.get("fit_seconds"), "predict_seconds": got.get("predict_seconds"),
            }))

        none = np.empty(0, int)
        for method in methods:
            made: dict[bytes, dict] = {}
            for r in range(repeats):
                test = np.flatnonzero(tested[:, r])
                if not len(test):
                    continue
                if 0 in budgets:
                    name = test.tobytes()
                    shared = name in made
                    if not shared:
                        made[name] = scores(method, source, none, test)
                    add(method, r, "population", 0, test, made[name], source, shared)
                    add(method, r, "source_plus_target", 0, test, made[name], source, True)
                for b in positive:
                    mine = np.flatnonzero(first[:, r] <= b)
                    if len(mine) < 2 * b:
                        continue
                    both = np.concatenate([source, mine])
                    add(method, r, "subject", b, test, scores(method, mine, mine, test), mine)
                    add(method, r, "source_plus_target", b, test, scores(method, both, mine, test), both)
        names = [c.split()[0] for c in PREDICTION.split(", ")]
        return pd.concat(out, ignore_index=True)[names] if out else pd.DataFrame({c: [] for c in names})

    return grid.groupBy("dataset", "target_subject").applyInPandas(fit, PREDICTION)


def references(grid: DataFrame, budgets: list[int], repeats: int) -> DataFrame:
    """dataset, target_subject, subject, part, repeat, budget, trials, uids (SHA-256 of the sorted ids), reference (SHA-256 of the mean covariance): what each
    alignment of a grid is made from. Sources have no repeat and budget."""
    schema = "dataset string, target_subject string, subject string, part string, repeat int, budget int, trials int, uids string, reference string"

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("trial_uid")
        x, uid, subject, rows = np.array([np.stack(v) for v in d["x"]], np.float64), d["trial_uid"].to_numpy(), d["subject"].to_numpy(), []
        square, source = x @ x.transpose(0, 2, 1), d["part"].to_numpy() == "source"
        first = np.array([[np.inf] * repeats if c is None else [np.inf if v is None or np.isnan(v) else v for v in np.array(c, float)] for c in d["chosen"]])

        def add(who: str, part: str, repeat: int | None, budget: int | None, at: np.ndarray) -> None:
            if len(at):
                rows.append((d["dataset"].iloc[0], d["target_subject"].iloc[0], who, part, repeat, budget, len(at), kernels.uid_digest(uid[at]), kernels.reference_digest(square[at].mean(axis=0))))

        for s in np.unique(subject[source]):
            add(s, "source", None, None, np.flatnonzero(source & (subject == s)))
        for r in range(repeats):
            for b in (b for b in budgets if b):
                add(d["target_subject"].iloc[0], "target", r, b, np.flatnonzero(~source & (first[:, r] <= b)))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
        return out.astype({"repeat": "Int32", "budget": "Int32"})

    return grid.groupBy("dataset", "target_subject").applyInPandas(run, schema)
