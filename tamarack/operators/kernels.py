"""Numerical kernels over arrays of epochs (trials, channels, samples): covariances, symmetric matrix functions, spatial filters, classifiers.

They see the trials of one condition, which the assignments bound, so they run inside a grouped map.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np

FLOOR = 1e-12


def log_variance(x: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    return np.log(x.var(axis=2, ddof=1) + eps)


def oas(x: np.ndarray, eps: float = 1e-10) -> np.ndarray:
    """Covariance of each epoch, shrunk to a multiple of the identity by the oracle-approximating weight, in closed form."""
    n, p = x.shape[2], x.shape[1]
    centred = x - x.mean(axis=2, keepdims=True)
    cov = centred @ centred.transpose(0, 2, 1) / n
    mu, square = np.trace(cov, axis1=1, axis2=2) / p, (cov**2).mean(axis=(1, 2))
    low = (n + 1) * (square - mu**2 / p)
    weight = np.where(low > 0, np.minimum(1.0, (square + mu**2) / np.where(low > 0, low, 1)), 1.0)[:, None, None]
    return (1 - weight) * cov + (weight * mu[:, None, None] + eps) * np.eye(p)


def ledoit_wolf(rows: np.ndarray) -> np.ndarray:
    """Covariance of rows, shrunk by the Ledoit-Wolf weight."""
    n, p = rows.shape
    c = rows - rows.mean(axis=0)
    cov = c.T @ c / n
    if p == 1:
        return cov
    mu = np.trace(cov) / p
    spread = (cov**2).sum() / p - mu**2
    noise = min(((c**2).sum(axis=1) ** 2).sum() / n - (cov**2).sum(), spread * p * n) / (p * n)
    weight = min(max(noise, 0.0), spread) / spread if spread > 0 else 0.0
    return (1 - weight) * cov + weight * mu * np.eye(p)


def on_eigenvalues(m: np.ndarray, f: Callable, floor: float | None = FLOOR) -> np.ndarray:
    """f of the eigenvalues (none below floor) of symmetric matrices."""
    value, vector = np.linalg.eigh((m + np.swapaxes(m, -1, -2)) / 2)
    value = f(value if floor is None else np.maximum(value, floor))
    return (vector * value[..., None, :]) @ np.swapaxes(vector, -1, -2)


def power(m: np.ndarray, exponent: float, floor: float = FLOOR) -> np.ndarray:
    return on_eigenvalues(m, lambda v: v**exponent, floor)


def log_map(m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithms of matrices in the frame whitened at a point."""
    white = power(at, -0.5)
    return on_eigenvalues(white @ m @ white, np.log)


def riemannian_mean(m: np.ndarray, most: int = 50, tolerance: float = 1e-9) -> np.ndarray:
    """The point at which the mean log map vanishes, by steps from the arithmetic mean."""
    mean = m.mean(axis=0) + FLOOR * np.eye(m.shape[1])
    for _ in range(most):
        step, root = log_map(m, mean).mean(axis=0), power(mean, 0.5)
        mean = root @ on_eigenvalues(step, np.exp, None) @ root
        if np.linalg.norm(step) < tolerance:
            break
    return mean


def half_vector(m: np.ndarray) -> np.ndarray:
    """Upper triangles, off-diagonal entries times the root of two, so that norms stay."""
    i, j = np.triu_indices(m.shape[-1])
    return m[..., i, j] * np.where(i == j, 1.0, np.sqrt(2.0))


def alignment(x: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    """The inverse root of the mean of X X', by which epochs are aligned."""
    if not len(x):
        raise ValueError("no trials to align to")
    return power((x @ x.transpose(0, 2, 1)).mean(axis=0), -0.5, eps)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


class Lda:
    """Linear discriminant with a Ledoit-Wolf covariance of each class's standardised rows, weighted by class share."""

    def fit(self, f: np.ndarray, y: np.ndarray) -> Lda:
        share, means, cov = [], [], 0.0
        for k in (0, 1):
            own = f[y == k]
            scale = own.std(axis=0)
            scale[scale == 0] = 1.0
            share.append(len(own) / len(f))
            means.append(own.mean(axis=0))
            cov = cov + share[k] * ledoit_wolf((own - means[k]) / scale) * np.outer(scale, scale)
        weights = np.linalg.lstsq(cov, np.array(means).T, rcond=None)[0]
        bias = np.log(share) - 0.5 * np.einsum("kp,pk->k", np.array(means), weights)
        self.w, self.b = weights[:, 1] - weights[:, 0], bias[1] - bias[0]
        return self

    def score(self, f: np.ndarray) -> np.ndarray:
        return sigmoid(f @ self.w + self.b)


class Logistic:
    """L2-penalised logistic regression on standardised features with balanced classes, by damped Newton steps."""

    def __init__(self, c: float = 1.0):
        self.c = c

    def fit(self, f: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.scale = f.mean(axis=0), f.std(axis=0)
        self.scale[self.scale == 0] = 1.0
        x = np.column_stack([(f - self.mean) / self.scale, np.ones(len(f))])
        weight = self.c * np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
        ridge, sign, w = np.append(np.ones(x.shape[1] - 1), 0.0), 2.0 * y - 1, np.zeros(x.shape[1])
        cost = lambda v: (weight * np.logaddexp(0, -sign * (x @ v))).sum() + 0.5 * (ridge * v * v).sum()
        for _ in range(200):
            p = sigmoid(x @ w)
            slope = x.T @ (weight * (p - y)) + ridge * w
            if np.abs(slope).max() < 1e-9:
                break
            curve = (x.T * (weight * p * (1 - p))) @ x + np.diag(ridge + 1e-12)
            step, size = np.linalg.solve(curve, slope), 1.0
            while size > 1e-6 and cost(w - size * step) > cost(w) - 1e-4 * size * (slope @ step):
                size /= 2
            w = w - size * step
        self.w = w
        return self

    def score(self, f: np.ndarray) -> np.ndarray:
        return sigmoid(((f - self.mean) / self.scale) @ self.w[:-1] + self.w[-1])


class LogVarianceLda:
    def fit(self, x: np.ndarray, y: np.ndarray) -> LogVarianceLda:
        self.model = Lda().fit(log_variance(x), y)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.model.score(log_variance(x))


class CspLda:
    """Spatial filters whose power tells the classes apart best, their log power, and a linear discriminant."""

    def __init__(self, components: int = 8):
        self.components = components

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(((self.filters @ x) ** 2).mean(axis=2), FLOOR))

    def fit(self, x: np.ndarray, y: np.ndarray) -> CspLda:
        zero, one = (ledoit_wolf(x[y == k].transpose(0, 2, 1).reshape(-1, x.shape[1])) for k in (0, 1))
        white = power(zero + one, -0.5)
        value, vector = np.linalg.eigh(white @ zero @ white)
        best = np.argsort(-np.abs(value - 0.5), kind="stable")[: min(self.components, x.shape[1])]
        self.filters = (white @ vector[:, best]).T
        self.model = Lda().fit(self.features(x), y)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.model.score(self.features(x))


class RiemannLogistic:
    """Shrunk covariances in the tangent space at their Riemannian mean, and logistic regression."""

    def __init__(self, c: float = 1.0, most: int = 50, tolerance: float = 1e-9):
        self.c, self.most, self.tolerance = c, most, tolerance

    def fit(self, x: np.ndarray, y: np.ndarray) -> RiemannLogistic:
        cov = oas(x)
        self.at = riemannian_mean(cov, self.most, self.tolerance)
        self.model = Logistic(self.c).fit(half_vector(log_map(cov, self.at)), y)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.model.score(half_vector(log_map(oas(x), self.at)))


#: Methods by name. A further one (say, a neural network) is added as an entry.
ESTIMATORS: dict[str, Callable] = {"logvar_lda": LogVarianceLda, "csp_lda": CspLda, "riemann_lr": RiemannLogistic}


def checked(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x and y, if a classifier can learn from them; else ValueError."""
    if x.ndim != 3 or len(x) != len(y):
        raise ValueError("expected trials, channels and samples, and a label for each trial")
    if set(np.unique(y)) != {0, 1}:
        raise ValueError("training needs both classes")
    if not np.isfinite(x).all():
        raise ValueError("training data are not finite")
    return x, y


def reference_digest(matrix: np.ndarray) -> str:
    """SHA-256 of a matrix's shape and its doubles, row by row."""
    m = np.ascontiguousarray(matrix, "<f8")
    return hashlib.sha256(json.dumps(list(m.shape)).encode() + m.tobytes()).hexdigest()


def uid_digest(uids) -> str:
    """SHA-256 of the sorted ids as compact JSON."""
    return hashlib.sha256(json.dumps(sorted(map(str, uids)), separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
