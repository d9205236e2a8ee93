"""Linear mixed model by maximum likelihood: fixed effects, and a random intercept and slope for each participant.

The likelihood needs, of each participant, only products of its columns. Participants with equal Z'Z share all that depends on the
variance parameters, so their products are summed where they lie, and what reaches the driver is a matrix for each such
pattern: a few, as budgets are few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.sources import kept


def minimum(f: Callable, start: np.ndarray, size: float = 0.3, most: int = 2000, tolerance: float = 1e-10) -> tuple[np.ndarray, float, bool]:
    """Nelder-Mead simplex search: the point, its value, whether it settled."""
    points = [start] + [start + size * e for e in np.eye(len(start))]
    values = [f(p) for p in points]
    for _ in range(most):
        order = np.argsort(values)
        points, values = [points[k] for k in order], [values[k] for k in order]
        if values[-1] - values[0] < tolerance and np.abs(points[-1] - points[0]).max() < 1e-7:
            return points[0], values[0], True
        centre = np.mean(points[:-1], axis=0)
        tries = {s: centre + s * (centre - points[-1]) for s in (1.0, 2.0, -0.5)}
        mirrored = f(tries[1.0])
        if mirrored < values[0]:
            far = f(tries[2.0])
            points[-1], values[-1] = (tries[2.0], far) if far < mirrored else (tries[1.0], mirrored)
        elif mirrored < values[-2]:
            points[-1], values[-1] = tries[1.0], mirrored
        elif (near := f(tries[-0.5])) < values[-1]:
            points[-1], values[-1] = tries[-0.5], near
        else:
            points = [points[0]] + [(p + points[0]) / 2 for p in points[1:]]
            values = [values[0]] + [f(p) for p in points[1:]]
    return points[0], values[0], False


def products(df: DataFrame, columns: list[str], slope: str | None) -> DataFrame:
    """pattern (Z'Z), participants, rows, s (W'W), q (sum of vec(W'Z) vec(W'Z)'). W: the columns, the last being the outcome."""
    z_columns = ["one_"] + ([slope] if slope else [])

    def each(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(columns).assign(one_=1.0)
        w, z = d[columns].to_numpy(float), d[z_columns].to_numpy(float)
        v = (w.T @ z).ravel()
        return pd.DataFrame({"pattern": [np.round(z.T @ z, 9).ravel().tolist()], "participants": [1], "n": [len(d)], "s": [(w.T @ w).ravel().tolist()], "q": [np.outer(v, v).ravel().tolist()]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for b in batches:
            for pattern, participants, n, s, q in zip(*[b[c] for c in ("pattern", "participants", "n", "s", "q")], strict=True):
                now = (participants, n, np.array(s), np.array(q))
                old = sums.get(key := tuple(pattern))
                sums[key] = now if old is None else tuple(a + b for a, b in zip(old, now, strict=True))
        yield pd.DataFrame([(list(k), v[0], v[1], v[2].tolist(), v[3].tolist()) for k, v in sums.items()], columns=["pattern", "participants", "n", "s", "q"])

    schema = "pattern array<double>, participants long, n long, s array<double>, q array<double>"
    own = df.groupBy("participant").applyInPandas(each, schema)
    partial = own.mapInPandas(added, schema)
    return partial.repartition("pattern").mapInPandas(added, schema)


def estimated(parts: list[tuple], p: int, slopes: bool) -> dict:
    """Estimates from the products: beta, se, variance, covariance of the random effects, log likelihood, whether the search settled."""
    r, n = 1 + slopes, sum(x[2] for x in parts)
    total = sum(np.array(x[3]).reshape(p + 1, p + 1) for x in parts)

    def pieces(theta: np.ndarray) -> tuple:
        root = np.zeros((r, r))
        root[np.tril_indices(r)] = theta
        left, log_det = total.copy(), 0.0
        for pattern, participants, _, _, q in parts:
            zz = np.array(pattern).reshape(r, r)
            inner = np.eye(r) + root.T @ zz @ root
            middle = root @ np.linalg.solve(inner, root.T)
            log_det += participants * np.linalg.slogdet(inner)[1]
            left -= np.einsum("iajb,ab->ij", np.array(q).reshape(p + 1, r, p + 1, r), middle)
        beta = np.linalg.solve(left[:p, :p], left[:p, p])
        variance = max(float(left[p, p] - left[:p, p] @ beta) / n, 1e-300)
        return beta, variance, left[:p, :p], log_det, root

    def cost(theta: np.ndarray) -> float:
        _, variance, _, log_det, _ = pieces(theta)
        return 0.5 * (n * np.log(2 * np.pi * variance) + n + log_det)

    theta, value, settled = minimum(cost, np.eye(r)[np.tril_indices(r)])
    beta, variance, normal, _, root = pieces(theta)
    return {"beta": beta, "se": np.sqrt(variance * np.diag(np.linalg.inv(normal))), "variance": variance, "random": variance * root @ root.T, "log_likelihood": -value, "settled": settled}


def terms(summary: DataFrame, metric: str, methods: list[str], regimes: list[str], slopes: bool = True) -> DataFrame:
    """term, estimate, se, model of: metric on log2 budget by method by regime, with datasets, and participants' random effects.

    The first method, regime and dataset are the base. Under three participants or twenty rows, or for a singular design, there are no terms
    but one row 'not_estimated'. A slope model that does not settle gives way to one with intercepts only."""
    spark = summary.sparkSession
    rows = kept(summary.filter(F.col("regime").isin(regimes) & F.col("method").isin(methods) & (F.col("budget") > 0) & F.col(metric).isNotNull()))  # a row for each condition
    datasets = [r.dataset for r in rows.select("dataset").distinct().orderBy("dataset").collect()]  # a row for each dataset
    size = rows.agg(F.count("*").alias("n"), F.countDistinct("dataset", "target_subject").alias("people")).first()
    schema = "term string, estimate double, se double, model string"
    if size.n < 20 or size.people < 3:
        return spark.createDataFrame([("not_estimated", None, None, "too few rows")], schema)
    is_method, is_regime = {m: (F.col("method") == m).cast("double") for m in methods[1:]}, {g: (F.col("regime") == g).cast("double") for g in regimes[1:]}
    x = F.col("log2_budget")
    cells = {"": F.lit(1.0)} | {f"method:{m}": c for m, c in is_method.items()} | {f"regime:{g}": c for g, c in is_regime.items()} | {f"method:{m}*regime:{g}": a * b for m, a in is_method.items() for g, b in is_regime.items()}
    columns = {name or "intercept": c for name, c in cells.items()} | {"log2_budget" + ("*" + name if name else ""): x * c for name, c in cells.items()} | {f"dataset:{v}": (F.col("dataset") == v).cast("double") for v in datasets[1:]}
    design = rows.select(F.concat_ws("::", "dataset", "target_subject").alias("participant"), x.cast("double").alias("slope_"), *[c.cast("double").alias(f"x{k}") for k, c in enumerate(columns.values())], F.col(metric).alias("y_"))
    names = [f"x{k}" for k in range(len(columns))] + ["y_"]
    for slope in ([True, False] if slopes else [False]):
        parts = [tuple(r) for r in products(design, names, "slope_" if slope else None).collect()]  # a row for each pattern
        try:
            got = estimated(parts, len(columns), slope)
        except np.linalg.LinAlgError:
            continue
        if got["settled"]:
            model = "random slope" if slope else "random intercept"
            out = [(t, float(b), float(s), model) for t, b, s in zip(columns, got["beta"], got["se"], strict=True)]
            labels = ["intercept_variance", "covariance", "slope_variance"] if slope else ["intercept_variance"]
            out += [(t, float(v), None, model) for t, v in zip(labels, got["random"][np.tril_indices(1 + slope)], strict=True)]
            return spark.createDataFrame(out + [("residual_variance", float(got["variance"]), None, model), ("log_likelihood", float(got["log_likelihood"]), None, model)], schema)
    return spark.createDataFrame([("not_estimated", None, None, "no fit settled")], schema)
