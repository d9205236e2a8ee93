"""The whole workflow over synthetic trials: twice, aligned, tampered with, resumed."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack import benchmark, cli, plans, provenance
from tamarack.config import Config
from tamarack.operators import bootstrap, report, reuse
from tamarack.sources import files, results, shards


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("smoke") / "work")
    return where, benchmark.smoke(spark, where), benchmark.smoke_config(where, "run-a")


def changed(c, **sections):
    values = json.loads(json.dumps(c.values))
    for name, own in sections.items():
        values[name] |= own
    return Config(values)


def test_smoke(spark, done):
    where, said, c = done
    assert said["status"] == said["audit_a"]["status"] == "ok" and said["successful_metric_rows"] == 108
    counts = {n: results.read(spark, c.output_dir, n).count() for n in ("predictions", *results.ASSIGNMENTS)}
    assert counts == {"predictions": 1296, "split_assignments": 144, "calibration_assignments": 96, "source_selection": 6, "source_trial_assignments": 144}
    assert files.exists(spark, f"{c.output_dir}/figures/figure_manifest.json") and files.exists(spark, f"{c.output_dir}/pairwise_tests.csv")
    with pytest.raises(ValueError, match="no workspace"):
        benchmark.smoke(spark, os.path.dirname(where))


def test_commands(spark, done, tmp_path, capsys):
    _, _, c = done
    path = benchmark.write_config(spark, c, str(tmp_path / "c.yaml"))
    assert cli.main(["environment", "--config", path]) == 0
    for command in ("validate-data", "run", "tables"):  # all conditions are done
        assert cli.main([command, "--config", path], spark) == 0
    assert cli.main(["audit", "--config", path], spark) == 0 and '"status": "ok"' in capsys.readouterr().out
    tex = files.read_text(spark, f"{c.output_dir}/tables/supplement_contrasts.tex")
    assert r"\toprule" in tex and "trials/class" in tex
    assert files.read_text(spark, f"{c.output_dir}/tables/table1_cohort.md").startswith("| Dataset |")


def test_a_run_goes_on_and_must_agree(spark, done):
    _, _, c = done
    m = results.read(spark, c.output_dir, "metrics").cache()
    assert m.count() == 108
    with pytest.raises(FileExistsError):
        other = changed(c, runtime={"resume": False})
        other.__class__ = type("Same", (Config,), {"output_dir": c.output_dir})
        benchmark.run(spark, other)
    path = f"{c.output_dir}/{provenance.MANIFEST}"
    was = files.read_json(spark, path)
    files.write_json(spark, path, was | {"package_versions": {}})
    with pytest.raises(ValueError, match="package_versions"):
        provenance.started(spark, c)
    files.write_json(spark, path, was)


def test_aligned_run(spark, done, tmp_path):
    where, _, c = done
    e = changed(c, alignment={"mode": benchmark.ALIGNED}, experiment={"output_root": f"{where}/aligned/results"})
    with pytest.raises(ValueError, match="assignments"):
        benchmark.run(spark, e)
    out = benchmark.run(spark, e, source=c.output_dir)
    m = results.read(spark, out, "metrics", True)
    assert m.count() == 72 and {x.regime for x in m.select("regime").distinct().collect()} == {"subject", "source_plus_target"}
    assert results.read(spark, out, "source_alignment_provenance").count() == 6 and results.read(spark, out, "target_alignment_provenance").count() == 12
    assert files.read_json(spark, f"{out}/{benchmark.REUSE}")["regeneration_equality_gate"]["status"] == "ok"
    benchmark.aggregate(spark, e)
    t = benchmark.aggregated(spark, e, "pairwise_tests")
    assert t.filter(F.lower("family").contains("confirmatory") | (F.col("inference_role") != "exploratory")).isEmpty() and not t.isEmpty()
    assert not files.exists(spark, f"{out}/aucc_subject.csv") and benchmark.aggregated(spark, e, "ea_regime_contrast_trajectory").count() == 6
    assert files.exists(spark, f"{benchmark.compare(spark, c, e, str(tmp_path / 'compare'))}/trajectory_comparison.csv")


def test_reused_assignments_must_be_those_assigned_afresh(spark, done):
    _, _, c = done
    taken = reuse.load(spark, c.output_dir)
    t = benchmark.trials(spark, c)
    assert set(taken.sha256) == set(results.ASSIGNMENTS) and taken.experiment_fingerprint == c.experiment_fingerprint
    split = taken.tables["split_assignments"]
    bad = taken.tables | {"split_assignments": split.withColumn("label", 1 - F.col("label"))}
    with pytest.raises(AssertionError, match="split_assignments"):
        reuse.verified(bad, taken.tables)
    one = reuse.splits(split, t).collect()
    assert len(one) == 6 and all(len(x.test) == len(x.calibration_pool) == 12 and not set(x.test) & set(x.calibration_pool) for x in one)
    assert {tuple(x.test_groups) for x in one} == {("1::0",)}
    own = reuse.samples(taken.tables["calibration_assignments"], t).collect()
    assert all(x.nested and x.class_0 == x.class_1 == x.budget_per_class for x in own) and len(own) == 12
    assert all(len(x.positions) == 24 for x in reuse.sources(taken.tables["source_selection"], taken.tables["source_trial_assignments"], t).collect())


def test_ids_recur_in_datasets(spark):
    """Positions are those of the same dataset's subject; an unknown id raises."""
    t = spark.createDataFrame([("A", "1", 0, 0, f"a{k}", k % 2) for k in range(4)] + [("B", "1", 0, 0, f"b{k}", k % 2) for k in range(3)], "dataset string, subject string, session int, run int, trial_uid string, label int")
    split = t.withColumnRenamed("subject", "target_subject").select("dataset", "target_subject", F.lit(0).alias("repeat"), F.lit("s").alias("split_strategy"), F.col("dataset").alias("split_id"), "trial_uid", F.lit("0::0").alias("group_id"), F.when(F.substring("trial_uid", 2, 1) == "0", "test").otherwise("calibration_pool").alias("role"))
    got = {x.dataset: (x.test, x.calibration_pool) for x in reuse.splits(split, t).collect()}
    assert got == {"A": ([0], [1, 2, 3]), "B": ([0], [1, 2])}
    lost = t.filter("trial_uid <> 'b2'")
    assert [x.trial_uid for x in reuse.unknown(split, lost).collect()] == ["b2"]
    with pytest.raises(Exception, match="b2"):
        reuse.splits(split, lost).collect()


def test_audit_finds_tampering(spark, done, tmp_path):
    _, _, c = done
    for name, change, rule in (
        ("metrics", {"roc_auc": F.when(F.col("target_subject") == "1", F.col("roc_auc") / 2).otherwise(F.col("roc_auc"))}, "recomputed"),
        ("source_selection", {"selected_trials": F.col("selected_trials") + 1}, "source_rollup"),
        ("calibration_assignments", {"trial_uid": F.when(F.col("budget_per_class") == 3, F.concat(F.col("trial_uid"), F.lit("x"))).otherwise(F.col("trial_uid"))}, "sample_in_pool"),
    ):
        e = changed(c, experiment={"output_root": str(tmp_path / name)})
        e.__class__ = type("Named", (Config,), {"output_dir": str(tmp_path / name / "out")})
        for n in ("metrics", "predictions", *results.ASSIGNMENTS):
            df = results.read(spark, c.output_dir, n)
            (df.withColumns(change) if n == name else df).write.parquet(f"{e.output_dir}/{n}")
        said = benchmark.audit(spark, e)
        assert said["status"] == "failed" and rule in said["error_message"], said
    assert benchmark.audit(spark, changed(c, experiment={"output_root": str(tmp_path)}))["error_type"] == "FileNotFoundError"


def test_worst_and_examples(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, None)], "k int, roc_auc double")
    b = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.1)], "k int, roc_auc double")
    assert [(x.metric, x.k, round(x.difference, 6)) for x in plans.worst(a, b, ["k"], ["roc_auc"]).collect()] == [("roc_auc", 2, 0.2)]
    assert [tuple(x) for x in plans.examples({"odd": a.filter("k % 2 = 1")}, 1).collect()] == [("odd", '{"k":1,"roc_auc":0.5}')]


def test_saved_trials_are_checked(spark, done, tmp_path):
    _, _, c = done
    t = benchmark.trials(spark, c)
    root = str(tmp_path / "shards")
    shards.save(t, root, {"a": 1}, {"v": "1"})
    assert shards.structure_differs(spark, root).isEmpty() and shards.changed(spark, root).isEmpty()
    with pytest.raises(ValueError, match="another version"):
        shards.save(t, root, {"a": 2}, {"v": "1"})
    for path in (tmp_path / "shards" / "trials").rglob("*.parquet"):
        (path.parent / ("." + path.name + ".crc")).unlink(missing_ok=True)
        path.write_bytes(path.read_bytes()[:-1] + b"\0")
        break
    assert shards.changed(spark, root).count() == 1
    with pytest.raises(ValueError, match="both_labels"):
        shards.save(t.filter("label = 0"), str(tmp_path / "other"), {}, {})


def test_bootstrap_is_numpys(spark):
    v = np.random.default_rng(1).normal(size=13)
    rng = np.random.default_rng(77)
    means = v[rng.integers(0, 13, (500, 13))].mean(axis=1)
    want = (v.mean(), *np.quantile(means, [0.025, 0.975]), 13)
    assert np.allclose(bootstrap.interval(v, 500, 0.95, 77), want)
    old, bootstrap.AT_ONCE = bootstrap.AT_ONCE, 13 * 7
    assert np.allclose(bootstrap.interval(v, 500, 0.95, 77), want)
    bootstrap.AT_ONCE = old
    assert bootstrap.interval([np.nan], 100, 0.9, 1) == (None, None, None, 0) and bootstrap.interval([2.0, np.nan], 100, 0.9, 1) == (2.0, 2.0, 2.0, 1)
    assert bootstrap.seed_of(20260811, "D", "1", "split") == 775142910
    df = spark.createDataFrame([("D", str(k), float(x)) for k, x in enumerate(v)], "dataset string, target_subject string, v double")
    got = bootstrap.intervals(df, ["dataset"], "v", 500, 0.95, lambda key: 77).first()
    order = v[[int(s) for s in sorted(map(str, range(13)))]]
    assert np.allclose((got.estimate, got.ci_lower, got.ci_upper), bootstrap.interval(order, 500, 0.95, 77)[:3])


def test_draws_of_published_streams():
    y = np.array([0, 1] * 10)
    got = bootstrap.nested(y, np.arange(16), [0, 2, 5], 3)
    assert not len(got[0]) and set(got[2]) <= set(got[5]) and (y[got[5]] == 1).sum() == 5
    rng = np.random.default_rng(3)
    zero = np.arange(0, 16, 2)
    rng.shuffle(zero)
    assert set(got[2]) >= set(zero[:2])
    with pytest.raises(ValueError, match="budget 9"):
        bootstrap.nested(y, np.arange(16), [9], 3)
    assert bootstrap.nested(y, np.arange(16), [9], 3, "skip") == {}
    assert bootstrap.source_subjects(["1", "2", "10"], "2", None, 1) == ["1", "10"] and len(bootstrap.source_subjects(list("12345"), "2", 2, 1)) == 2
    assert sorted(y[bootstrap.source_trials(y, 4, True, 1)].tolist()) == [0] * 4 + [1] * 4


def test_text_of_tables(spark):
    df = spark.createDataFrame([("a_b", 0.12345, 0.0004, 3), ("c", None, 0.2, None)], "name string, mean double, p double, n int")
    columns = {"name": "Name", "mean": "Mean", "p": "$p$", "n": "$n$"}
    assert r"a\_b & 0.123 & $<$0.001* & 3 \\" in report.latex(df, columns, "x", "tab:x") and "| c | -- | 0.200 | -- |" in report.markdown(df, columns)
