"""Means of groups that no task holds, against the mean of a group at hand."""

import numpy as np
import pytest

from tamarack.operators import kernels, means


@pytest.mark.parametrize("parts", [1, 5])
def test_equal_to_the_mean_at_hand(spark, parts):
    r = np.random.default_rng(parts)
    groups = {}
    for k, (n, p) in enumerate([(40, 3), (1, 3), (2, 2), (25, 5)]):
        x = r.normal(size=(n, p, 30)) * (1 + 3 * r.random((n, p, 1)))
        groups[f"g{k}"] = x @ x.transpose(0, 2, 1) / 30
    rows = [(g, k % 2, m.tolist()) for g, v in groups.items() for k, m in enumerate(v)]
    df = spark.createDataFrame(rows, "g string, odd int, m array<array<double>>")
    got = {x.g: x for x in means.riemannian_means(df, ["g"], parts=parts).collect()}
    assert got.keys() == groups.keys()
    for g, v in groups.items():
        want = kernels.riemannian_mean(v)
        assert got[g].n == len(v) and got[g].residual < 1e-6 and np.allclose(np.array(got[g].mean).reshape(want.shape), want, atol=1e-8)
    if parts == 5:
        both = means.riemannian_means(df, ["g", "odd"], parts=2).collect()
        assert {(x.g, x.odd): x.n for x in both} == {(g, o): len(v[o::2]) for g, v in groups.items() for o in (0, 1) if len(v[o::2])}
        own = next(x for x in both if (x.g, x.odd) == ("g0", 1))
        assert np.allclose(np.array(own.mean).reshape(3, 3), kernels.riemannian_mean(groups["g0"][1::2]), atol=1e-8)


def test_rounds_end(spark):
    """A group that is not there yet when rounds are used up is given as it is, with its residual."""
    x = np.random.default_rng(0).normal(size=(10, 3, 8)) * np.array([1, 10, 100])[:, None]
    df = spark.createDataFrame([("g", (v @ v.T).tolist()) for v in x], "g string, m array<array<double>>")
    one = means.riemannian_means(df, ["g"], most=1).first()
    assert one.residual > 1e-9 and one.n == 10
    assert means.riemannian_means(df.limit(0), ["g"]).collect() == []
