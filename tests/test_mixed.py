import numpy as np
import pytest

from tamarack import kernel_queries
from tamarack.operators import mixed
from tests.conftest import SF

METHODS, REGIMES = ["a", "b"], ["subject", "source_plus_target"]


def simulated(people, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(people):
        u = rng.multivariate_normal([0, 0], [[0.04, 0.005], [0.005, 0.01]])
        for m in METHODS:
            for g in REGIMES:
                for b in (1, 3, 7, 15):
                    x = float(np.log2(b + 1))
                    y = 0.5 + u[0] + (0.05 + u[1]) * x + 0.1 * (m == "b") + 0.02 * x * (g == REGIMES[1]) + rng.normal(0, 0.05)
                    rows.append((f"D{s % 2}", str(s), m, g, b, x, float(y)))
    return rows


def test_estimates_are_those_of_the_dense_likelihood(spark):
    rows = simulated(60)
    df = spark.createDataFrame(rows, "dataset string, target_subject string, method string, regime string, budget int, log2_budget double, roc_auc double")
    got = {r.term: (r.estimate, r.se) for r in mixed.terms(df, "roc_auc", METHODS, REGIMES).collect()}
    assert abs(got["method:b"][0] - 0.1) < 0.03 and abs(got["log2_budget*regime:source_plus_target"][0] - 0.02) < 0.01
    assert abs(got["residual_variance"][0] - 0.0025) < 0.0004 and 0.02 < got["intercept_variance"][0] < 0.07

    def dense(d):
        total, xs, ys, vs = 0.0, [], [], []
        for s in {r[1] for r in rows}:
            own = [r for r in rows if r[1] == s]
            z = np.array([[1.0, r[5]] for r in own])
            m, g = np.array([r[2] == "b" for r in own], float), np.array([r[3] == REGIMES[1] for r in own], float)
            base = np.column_stack([np.ones(len(own)), m, g, m * g])
            xs.append(np.column_stack([base, base * z[:, 1:], [r[0] == "D1" for r in own]]))
            ys.append(np.array([r[6] for r in own]))
            vs.append(d[3] * np.eye(len(own)) + z @ np.array([[d[0], d[1]], [d[1], d[2]]]) @ z.T)
        a = sum(x.T @ np.linalg.solve(v, x) for x, v in zip(xs, vs, strict=True))
        beta = np.linalg.solve(a, sum(x.T @ np.linalg.solve(v, y) for x, y, v in zip(xs, ys, vs, strict=True)))
        for x, y, v in zip(xs, ys, vs, strict=True):
            e = y - x @ beta
            total -= 0.5 * (len(y) * np.log(2 * np.pi) + np.linalg.slogdet(v)[1] + e @ np.linalg.solve(v, e))
        return total

    at = [got[k][0] for k in ("intercept_variance", "covariance", "slope_variance", "residual_variance")]
    best = dense(at)
    assert np.isclose(best, got["log_likelihood"][0], atol=1e-5)
    for k in range(4):
        for f in (0.97, 1.03):
            assert dense([v * (f if i == k else 1) for i, v in enumerate(at)]) < best


def test_too_few_rows(spark):
    df = spark.createDataFrame(simulated(1), "dataset string, target_subject string, method string, regime string, budget int, log2_budget double, roc_auc double")
    assert [r.term for r in mixed.terms(df, "roc_auc", METHODS, REGIMES).collect()] == ["not_estimated"]


@pytest.mark.parametrize("name", ["ea_identity_residual", "riemann_mean_residual"])
def test_residuals_vanish(spark, name):
    rows = kernel_queries.__dict__[name](spark, SF).collect()
    assert len(rows) == 10 and max(r.residual for r in rows) < 1e-5


def test_shuffled_labels_give_chance(spark):
    rows = kernel_queries.shuffled_label_control(spark, SF).collect()
    assert len(rows) == 3 and all(0.4 < r["mean"] < 0.6 for r in rows)


@pytest.mark.parametrize("name", ["condition_runs", "aligned_condition_runs", "tangent_norm", "mixed_lm_terms", "random_intercept_terms", "mean_trajectory"])
def test_queries_give_rows(spark, name):
    assert kernel_queries.__dict__[name](spark, SF).count() > 0
