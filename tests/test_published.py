"""A run whose assignments come from NumPy's published streams: its four tables row by row, its audit, its model and robustness, and a run in waves that breaks off."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack import benchmark
from tamarack.config import Config
from tamarack.operators import published
from tamarack.sources import files, results


def digest(value, n):
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:n]


def seed_of(*parts):
    return int.from_bytes(hashlib.sha256(json.dumps([parts[0], *map(str, parts[1:])], separators=(",", ":")).encode()).digest()[:4], "big")


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("published"))
    values = json.loads(json.dumps(benchmark.smoke_config(where, "run").values))
    values |= {"draws": {"stream": "numpy"}, "source": {"max_subjects": 2, "max_trials_per_class_per_subject": 4, "balance_classes_within_subject": True}}
    values["datasets"] = [{"name": "SyntheticMI", "subjects": [1, 2, 3], "exclude_subjects": []}]
    values["analysis"] |= {"fit_mixed_effects": True}
    c = Config(values)
    benchmark.prepare(spark, c)
    patch = pytest.MonkeyPatch()
    patch.setattr(benchmark, "WAVE", 2)
    out = benchmark.run(spark, c)
    patch.undo()
    return c, out


def plain_tables(t, c):
    """From trials (subject -> rows of uid, session, run, label in order), with NumPy alone."""
    seed, s, out = c["experiment"]["seed"], c["source"], {n: [] for n in results.ASSIGNMENTS}
    d = "SyntheticMI"
    for target, rows in t.items():
        last = max(r[1] for r in rows)
        test, pool = [k for k, r in enumerate(rows) if r[1] == last], [k for k, r in enumerate(rows) if r[1] != last]
        name = "latest_session_holdout"
        sessions = sorted({r[1] for r in rows})
        split_id = digest({"strategy": name, "calibration_trial_uids": sorted(rows[k][0] for k in pool), "test_trial_uids": sorted(rows[k][0] for k in test), "details": {"test_session": str(last), "calibration_sessions": [str(x) for x in sessions[:-1]], "chronological": True}}, 20)
        about = lambda k, rows=rows: (rows[k][0], str(rows[k][1]), str(rows[k][2]), f"{rows[k][1]}::{rows[k][2]}", rows[k][3])
        for repeat in range(c["split"]["repeats"]):
            out["split_assignments"] += [(d, target, repeat, name, split_id, *about(k), "test" if k in test else "calibration_pool") for k in range(len(rows))]
            g = np.random.default_rng(seed_of(seed, d, target, repeat, "calibration"))
            order = []
            for label in (0, 1):
                own = np.array([k for k in pool if rows[k][3] == label])
                g.shuffle(own)
                order.append(own)
            for b in c["calibration"]["budgets_per_class"][1:]:
                for k in [*order[0][:b], *order[1][:b]]:
                    least = min(x for x in c["calibration"]["budgets_per_class"][1:] if k in [*order[0][:x], *order[1][:x]])
                    out["calibration_assignments"].append((d, target, repeat, split_id, b, *about(k), least))
        others = sorted(x for x in t if x != target)
        if s["max_subjects"] < len(others):
            others = sorted(np.random.default_rng(seed_of(seed, d, target, "source_subjects")).choice(np.array(others, object), s["max_subjects"], replace=False).tolist())
        for source in others:
            pair, rows = seed_of(seed, d, target, source, "source_trials"), t[source]
            g, of = np.random.default_rng(pair), [np.array([k for k, r in enumerate(rows) if r[3] == x]) for x in (0, 1)]
            n = min(len(of[0]), len(of[1]), s["max_trials_per_class_per_subject"])
            for own in of:
                g.shuffle(own)
            taken = [rows[k] for own in of for k in own[:n]]
            out["source_selection"].append((d, target, source, pair, 2 * n, n, n, digest(sorted(r[0] for r in taken), 64)))
            out["source_trial_assignments"] += [(d, target, source, pair, r[0], str(r[1]), str(r[2]), r[3]) for r in taken]
    return out


def test_assignments_are_numpys(spark, done):
    c, out = done
    t = {}
    for r in benchmark.trials(spark, c).select("subject", "trial_uid", "session", "run", "label", "trial_index").orderBy("subject", "session", "run", "trial_index").collect():
        t.setdefault(r.subject, []).append((r.trial_uid, r.session, r.run, r.label))
    want = plain_tables(t, c)
    for name in results.ASSIGNMENTS:
        got = [tuple(r) for r in results.read(spark, out, name).collect()]
        assert sorted(got) == sorted(want[name]) and got, name


def test_the_run_is_whole(spark, done):
    c, out = done
    assert benchmark.audit(spark, c)["status"] == "ok" and results.read(spark, out, "metrics").count() == 108
    assert not files.exists(spark, f"{out}/.fits") and results.read(spark, out, "failures").count() == 0
    usual = Config({k: v for k, v in c.values.items() if k != "draws"})
    assert usual.experiment_fingerprint != c.experiment_fingerprint and "draws" in usual.values
    with pytest.raises(ValueError, match="single trials"):
        published.tables(benchmark.trials(spark, c), 1, c["split"] | {"allow_trial_level_fallback": True}, c["calibration"], c["source"])
    with pytest.raises(ValueError, match="broken rule"):
        Config(c.values | {"draws": {"stream": "dice"}})


def test_model_tables_and_robustness(spark, done):
    """The mixed model in a run, the tables made of it, and what is left without a dataset."""
    c, out = done
    benchmark.aggregate(spark, c)
    said = files.read_json(spark, f"{out}/mixed_effects_diagnostics.json")
    terms = benchmark.aggregated(spark, c, "mixed_effects_coefficients")
    assert said["status"] in ("ok", "not_estimated") and not terms.isEmpty()
    benchmark.tables(spark, c)
    assert files.exists(spark, f"{out}/tables/table_manifest.json")
    with pytest.raises(Exception, match="participants left: 0"):
        benchmark.robustness(spark, c, "SyntheticMI", 3)
    at = benchmark.robustness(spark, c, "Another", 3)  # nothing is taken away, so tests stay what they are
    read = lambda n: spark.read.option("header", True).csv(f"{at}/{n}.csv")
    keys = ["contrast", "scope_dataset", "method_left", "method_right", "budget"]
    with_, without = (
        {tuple(r[k] for k in have): float(r["mean"]) for r in df.collect() if r["mean"] is not None}
        for df in (spark.read.option("header", True).csv(f"{out}/pairwise_tests.csv"), read("without_dataset_pairwise_tests"))
        for have in [[k for k in keys if k in df.columns]]
    )
    assert with_ and all(with_[k] == pytest.approx(v) for k, v in without.items()) and set(without) <= set(with_)
    assert files.read_json(spark, f"{at}/robustness_manifest.json")["participants_left"] == 3
    both = read("mixed_model_structure_comparison")
    assert {r.term for r in both.select("term").collect()} >= {r.term for r in terms.select("term").collect()}
    assert read("random_intercept_only_coefficients").count() > 0 and read("fraction_benefiting").count() == 3 * 2 * 2


def test_a_run_that_breaks_off_goes_on(spark, tmp_path):
    """Two waves; the second's metrics are not written at first. What was written is not written twice, and nothing is lost."""
    where = str(tmp_path)
    c = benchmark.smoke_config(where, "run")
    benchmark.prepare(spark, c)
    patch, calls, append = pytest.MonkeyPatch(), [], results.append

    def breaks(df, out, name, *more):
        calls.append(name)
        if calls.count("metrics") == 2:
            raise RuntimeError("lost")
        append(df, out, name, *more)

    patch.setattr(benchmark, "WAVE", 2)
    patch.setattr(results, "append", breaks)
    with pytest.raises(RuntimeError, match="lost"):
        benchmark.run(spark, c)
    patch.setattr(results, "append", append)
    first = results.read(spark, c.output_dir, "metrics")
    assert first.select("target_subject").distinct().count() == 2 and results.read(spark, c.output_dir, "predictions").count() == 1296
    was = {tuple(r) for r in first.select("target_subject", "method", "regime", "budget_per_class", "repeat", "fit_seconds").collect()}
    out = benchmark.run(spark, c)
    patch.undo()
    m = results.read(spark, out, "metrics")
    assert m.count() == 108 and results.read(spark, out, "predictions").count() == 1296 and benchmark.audit(spark, c)["status"] == "ok"
    assert was <= {tuple(r) for r in m.select("target_subject", "method", "regime", "budget_per_class", "repeat", "fit_seconds").collect()}  # the first wave is not fitted again
    assert m.filter(F.col("status") != "ok").isEmpty()
