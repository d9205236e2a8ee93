import numpy as np
import pytest

from tamarack.operators import kernels as k
from tamarack.operators import metrics, runner
from tamarack.sources import synthetic


def epochs(n=24, c=3, t=96, seed=1):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    x = rng.standard_normal((n, c, t)) * 0.5
    wave = np.sin(2 * np.pi * 10 * np.arange(t) / 96)
    x[y == 0, 0] += 1.2 * wave
    x[y == 1, c - 1] += 1.2 * wave
    return x, y


def test_matrix_functions():
    cov = k.oas(epochs()[0])
    assert np.linalg.eigvalsh(cov).min() > 0
    assert np.allclose(k.power(cov, 0.5) @ k.power(cov, 0.5), cov)
    mean = k.riemannian_mean(cov)
    assert np.linalg.norm(k.log_map(cov, mean).mean(axis=0)) < 1e-8
    logs = k.log_map(cov, mean)
    assert np.allclose(np.linalg.norm(k.half_vector(logs), axis=1), np.linalg.norm(logs, axis=(1, 2)))


def test_mean_of_commuting_matrices_is_geometric():
    d = np.array([np.diag([1.0, 4.0]), np.diag([4.0, 1.0])])
    assert np.allclose(k.riemannian_mean(d), 2 * np.eye(2))


def test_alignment_gives_identity_even_if_rank_deficient():
    x = epochs()[0]
    aligned = k.alignment(x) @ x
    assert np.allclose((aligned @ aligned.transpose(0, 2, 1)).mean(axis=0), np.eye(3))
    flat = np.repeat(x[:, :1], 3, axis=1)
    assert np.isfinite(k.alignment(flat, 1e-8)).all()
    with pytest.raises(ValueError):
        k.alignment(x[:0])


def test_ledoit_wolf_by_definition():
    rows = np.random.default_rng(3).standard_normal((20, 4)) * [1, 2, 3, 4]
    c = rows - rows.mean(axis=0)
    s = c.T @ c / 20
    mu = np.trace(s) / 4
    d2 = ((s - mu * np.eye(4)) ** 2).sum() / 4
    b2 = sum(((np.outer(v, v) - s) ** 2).sum() / 4 for v in c) / 400
    w = min(b2, d2) / d2
    assert np.allclose(k.ledoit_wolf(rows), (1 - w) * s + w * mu * np.eye(4))


def test_logistic_slope_vanishes_at_its_solution():
    x, y = epochs()
    f = k.log_variance(x)
    m = k.Logistic().fit(f, y)
    z = (f - m.mean) / m.scale
    p = m.score(f)
    assert np.abs(z.T @ (p - y) + m.w[:-1]).max() < 1e-6 and abs((p - y).sum()) < 1e-6


@pytest.mark.parametrize("method", sorted(k.ESTIMATORS))
def test_methods_tell_separable_classes_apart(method):
    x, y = epochs()
    assert (((k.ESTIMATORS[method]().fit(x, y).score(x)) >= 0.5) == y).mean() > 0.9


def test_training_data_are_checked():
    x, y = epochs()
    for bad in ((x[0], y), (x, y * 0), (x * np.nan, y)):
        with pytest.raises(ValueError):
            k.checked(*bad)


@pytest.mark.parametrize("aligned", [False, True])
def test_smoke_counts(spark, aligned):
    got = runner.run(synthetic.trials(spark), ["csp_lda", "riemann_lr", "logvar_lda"], [0, 3, 5], 2, 20260811, aligned=aligned).cache()
    keys = ["dataset", "target_subject", "repeat", "method", "regime", "budget"]
    m = metrics.binary_metrics(got, keys).cache()
    assert got.filter("error is not null").isEmpty() and got.count() == 1296 and m.count() == 108
    means = {r.regime: r.a for r in m.groupBy("regime").avg("roc_auc").withColumnRenamed("avg(roc_auc)", "a").collect()}
    assert min(means.values()) > 0.8
    both = got.filter("budget = 0").groupBy("target_subject", "repeat", "method", "trial_uid").agg({"y_score": "max", "regime": "count"})
    assert both.filter("`count(regime)` <> 2").isEmpty()
    assert runner.samples(synthetic.trials(spark).drop("x").filter("session = 0"), [0, 3, 5], 2, 1).count() == 96
