import itertools

import numpy as np
import pytest

from tamarack import config
from tamarack.operators import statistics

FULL = {
    "experiment": {"name": "bci-calibration-full-v1", "seed": 20260811},
    "preprocessing": {},
    "datasets": [{"name": "Lee2019_MI"}, {"name": "BNCI2014_001"}, {"name": "Zhou2016", "exclude_subjects": [2, 4]}],
    "source": {"max_subjects": 10, "max_trials_per_class_per_subject": 20},
}


def changed(section, **values):
    return FULL | {section: FULL.get(section, {}) | values}


def test_published_fingerprint():
    assert config.Config(FULL).experiment_fingerprint == "3fb8efe7e617b0c1"
    assert config.Config(changed("alignment", epsilon=1e-9)).experiment_fingerprint == "3fb8efe7e617b0c1"
    assert config.Config(changed("alignment", mode="euclidean_training_only")).experiment_fingerprint != "3fb8efe7e617b0c1"


@pytest.mark.parametrize("bad", [
    changed("experiment", name=" "), changed("experiment", seed=-1), changed("preprocessing", fmin=0), changed("preprocessing", tmax=0.1), changed("preprocessing", resample=60),
    changed("preprocessing", dtype="int8"), changed("preprocessing", channels=[]), changed("preprocessing", channels=["C3", "C3"]), changed("split", policy="x"),
    changed("split", test_fraction=1), changed("split", repeats=0), changed("split", minimum_calibration_per_class=39), changed("calibration", budgets_per_class=[5, 40]),
    changed("calibration", budgets_per_class=[0, 40, 5]), changed("calibration", nested=False), changed("calibration", insufficient_budget="x"), changed("source", max_subjects=0),
    FULL | {"datasets": []}, FULL | {"datasets": [{"name": "A"}, {"name": "A"}]}, FULL | {"datasets": [{"name": "A", "subjects": []}]},
    FULL | {"datasets": [{"name": "A", "subjects": [1, 2], "exclude_subjects": [2]}]}, FULL | {"methods": []}, FULL | {"methods": ["x"]}, changed("metrics", primary="accuracy"),
    changed("classical", logistic_c=0), changed("analysis", bootstrap_resamples=99), changed("analysis", ci_level=1), changed("analysis", pairwise_budgets=[7]),
    changed("analysis", aucc_max_budget_per_class=7), changed("analysis", roc_auc_threshold=2), changed("runtime", n_jobs_data=0), changed("alignment", mode="x"), FULL | {"other": {}},
    changed("split", other=1),
])
def test_broken_rules(bad):
    with pytest.raises(ValueError):
        config.Config(bad)


def test_wrong_kinds():
    for bad in (changed("experiment", seed="1"), changed("runtime", resume=1), FULL | {"split": []}, FULL | {"datasets": "x"}):
        with pytest.raises(TypeError):
            config.Config(bad)


def test_exact_p_by_enumeration():
    for n in (1, 2, 5, 9):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product([0, 1], repeat=n)]
        for w in range(n * (n + 1) // 4 + 1):
            assert np.isclose(statistics.exact_p(n, w), min(1, 2 * np.mean([x <= w for x in sums])))


def test_paired_tests(spark):
    rows = [("a", float(v)) for v in (1, 2, -3, 4, 5)] + [("b", 0.0)] * 3 + [("c", float(v)) for v in (1, 1, -2, 3)]
    got = {r.k: r for r in statistics.tests(spark.createDataFrame(rows, "k string, difference double"), ["k"]).collect()}
    assert (got["a"].statistic, round(got["a"].p, 9)) == (3.0, round(statistics.exact_p(5, 3), 9))
    assert (got["b"].statistic, got["b"].p, got["b"].rank_biserial) == (0.0, 1.0, 0.0)
    assert 0 < got["c"].p < 1 and got["c"].statistic == 3.0
