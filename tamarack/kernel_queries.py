"""Queries of epochs, fits and models, over whole tables, and SQL where there is some."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack import sources
from tamarack.operators import curves, kernels, means, metrics, mixed, runner
from tamarack.queries import MODES, PAIR, REPEAT, SEED, query, rounded, summary

PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
CHANNELS = "e AS (SELECT vec_id, CAST(vec_id % 10 AS VARCHAR) AS subject, [CAST(embedding[k * 16 + 1 : k * 16 + 16] AS DOUBLE[]) FOR k IN [0, 1, 2, 3]] AS x FROM embeddings)"


def dot(i: int, j: int) -> Column:
    return F.aggregate(F.zip_with(F.get("x", F.lit(i)), F.get("x", F.lit(j)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def covariance(i: int, j: int) -> Column:
    mean = [F.aggregate(F.get("x", F.lit(k)), F.lit(0.0), lambda s, v: s + v) / 16 for k in (i, j)]
    return dot(i, j) / 16 - mean[0] * mean[1]


def cov_sql(i: int, j: int) -> str:
    return f"(list_dot_product(x[{i + 1}], x[{j + 1}]) / 16 - list_sum(x[{i + 1}]) / 16 * list_sum(x[{j + 1}]) / 16)"


@query(f"WITH {CHANNELS} SELECT vec_id, {', '.join(f'round({cov_sql(i, j)}, 6) + 0.0::DOUBLE AS c{i}{j}' for i, j in PAIRS)} FROM e")
def epoch_covariance(spark, d):
    return rounded(sources.epochs(spark, d).select("vec_id", *[covariance(i, j).alias(f"c{i}{j}") for i, j in PAIRS]))


SQUARES = " + ".join(f"{1 if i == j else 2} * c{i}{j} * c{i}{j}" for i, j in PAIRS)


@query(f"""WITH {CHANNELS}, c AS (SELECT vec_id, {', '.join(f'{cov_sql(i, j)} AS c{i}{j}' for i, j in PAIRS)} FROM e), m AS (SELECT *, (c00 + c11 + c22 + c33) / 4 AS mu, ({SQUARES}) / 16 AS sq FROM c),
 w AS (SELECT *, CASE WHEN sq - mu * mu / 4 > 0 THEN least(1.0::DOUBLE, (sq + mu * mu) / (17 * (sq - mu * mu / 4))) ELSE 1.0::DOUBLE END AS w FROM m)
SELECT vec_id, round(w, 6) AS weight, {', '.join(f'round((1 - w) * c{k}{k} + w * mu, 6) AS o{k}{k}' for k in range(4))}, round((1 - w) * c01, 6) + 0.0::DOUBLE AS o01 FROM w""")
def oas_covariance(spark, d):
    c = sources.epochs(spark, d).select("vec_id", *[covariance(i, j).alias(f"c{i}{j}") for i, j in PAIRS])
    m = c.withColumn("mu", F.expr("(c00 + c11 + c22 + c33) / 4")).withColumn("sq", F.expr(f"({SQUARES}) / 16")).withColumn("low", F.expr("17 * (sq - mu * mu / 4)"))
    w = m.withColumn("weight", F.when(F.col("low") > 0, F.least(F.lit(1.0), F.try_divide(F.expr("sq + mu * mu"), F.col("low")))).otherwise(F.lit(1.0)))
    return rounded(w.select("vec_id", "weight", *[F.expr(f"(1 - weight) * c{k}{k} + weight * mu").alias(f"o{k}{k}") for k in range(4)], F.expr("(1 - weight) * c01").alias("o01")))


@query(f"WITH {CHANNELS} SELECT subject, count(*) AS n, {', '.join(f'round(avg(list_dot_product(x[{i + 1}], x[{j + 1}])), 6) + 0.0::DOUBLE AS r{i}{j}' for i, j in PAIRS)} FROM e GROUP BY ALL")
def ea_mean_cov(spark, d):
    e = sources.epochs(spark, d).withColumn("subject", F.col("subject").cast("string"))
    return rounded(e.groupBy("subject").agg(F.count("*").alias("n"), *[F.avg(dot(i, j)).alias(f"r{i}{j}") for i, j in PAIRS]))


def epoch_trials(spark, d) -> DataFrame:
    """Epochs as trials of ten subjects with three sessions."""
    e = sources.epochs(spark, d)
    return e.select(F.lit("E").alias("dataset"), F.col("subject").cast("string").alias("subject"), F.floor(F.col("vec_id") / 10 % 3).cast("int").alias("session"), F.concat(F.lit("V:"), F.col("vec_id").cast("string")).alias("trial_uid"), F.col("label").cast("int").alias("label"), "x")


@query("SELECT DISTINCT CAST(vec_id % 10 AS BIGINT) AS subject, 0.0::DOUBLE AS residual FROM embeddings")
def ea_identity_residual(spark, d):
    """How far each subject's mean X X' is from the identity once its epochs are aligned; the mean matrix is all that is gathered."""
    e = sources.epochs(spark, d).groupBy("subject").agg(*[F.avg(dot(i, j)).alias(f"r{i}{j}") for i, j in PAIRS])

    def run(batches):
        for b in batches:
            m = np.zeros((len(b), 4, 4))
            for i, j in PAIRS:
                m[:, i, j] = m[:, j, i] = b[f"r{i}{j}"]
            white = kernels.power(m, -0.5)
            yield pd.DataFrame({"subject": b["subject"], "residual": np.round(np.linalg.norm(white @ m @ white - np.eye(4), axis=(1, 2)), 6)})

    return e.mapInPandas(run, "subject long, residual double")


def stacked(b: pd.DataFrame) -> np.ndarray:
    return np.array([np.stack(v) for v in b["x"]], np.float64)


@query()
def tangent_norm(spark, d):
    """Norm of each epoch's shrunk covariance in the tangent space at the identity."""
    return tangent_norms(sources.epochs(spark, d))


def tangent_norms(e: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            if len(b):
                v = kernels.half_vector(kernels.on_eigenvalues(kernels.oas(stacked(b)), np.log))
                yield pd.DataFrame({"vec_id": b["vec_id"], "norm": np.round(np.linalg.norm(v, axis=1), 6)})

    return e.select("vec_id", "x").mapInPandas(run, "vec_id long, norm double")


@query()
def riemann_mean_residual(spark, d):
    """Norm of the mean log map at the mean of each subject's calibration sample, which budgets bound."""
    t = epoch_trials(spark, d)
    sample = runner.samples(t.drop("x").filter("session < 2"), [5], 1, SEED).select("dataset", "subject", "trial_uid").join(t, ["dataset", "subject", "trial_uid"])

    def mean(b: pd.DataFrame) -> pd.DataFrame:
        cov = kernels.oas(stacked(b.sort_values("trial_uid")))
        at = kernels.riemannian_mean(cov)
        return pd.DataFrame({"subject": [b["subject"].iloc[0]], "n": [len(b)], "residual": [round(float(np.linalg.norm(kernels.log_map(cov, at).mean(axis=0))), 6)]})

    return sample.groupBy("subject").applyInPandas(mean, "subject string, n long, residual double")


COV2 = [(0, 0), (0, 1), (1, 1)]


@query("SELECT CAST(vec_id % 10 AS BIGINT) AS subject, count(*) AS n, 0.0::DOUBLE AS residual FROM embeddings GROUP BY ALL")
def riemann_means(spark, d):
    """Each subject's mean over all its epochs, gathered nowhere; the mean log map vanishes there."""
    c = sources.epochs(spark, d).select("subject", F.array(*[F.array(*[covariance(min(i, j), max(i, j)) + (1e-3 if i == j else 0.0) for j in range(4)]) for i in range(4)]).alias("m"))
    return rounded(means.riemannian_means(c, ["subject"], parts=4).select("subject", "n", "residual"))


@query(f"""WITH {CHANNELS}, c AS (SELECT subject, vec_id // 10 % 2 AS half, {', '.join(f'avg({cov_sql(i, j)}) AS c{i}{j}' for i, j in COV2)} FROM e GROUP BY ALL),
 p AS (SELECT subject, any_value(c00) FILTER (half = 0) AS a, any_value(c01) FILTER (half = 0) AS b, any_value(c11) FILTER (half = 0) AS c, any_value(c00) FILTER (half = 1) AS x, any_value(c01) FILTER (half = 1) AS y, any_value(c11) FILTER (half = 1) AS z FROM c GROUP BY ALL),
 r AS (SELECT *, sqrt(a * c - b * b) AS s, sqrt(x * z - y * y) AS t FROM p), w AS (SELECT *, a / s + x / t AS g00, b / s + y / t AS g01, c / s + z / t AS g11 FROM r), f AS (SELECT *, sqrt(s * t) / sqrt(g00 * g11 - g01 * g01) AS k FROM w)
SELECT subject, round(k * g00, 6) + 0.0::DOUBLE AS m00, round(k * g01, 6) + 0.0::DOUBLE AS m01, round(k * g11, 6) + 0.0::DOUBLE AS m11 FROM f""")
def riemann_pair_means(spark, d):
    """The mean of two matrices of two channels of each subject; there is a closed form."""
    e = sources.epochs(spark, d).withColumns({"subject": F.col("subject").cast("string"), "half": F.floor(F.col("vec_id") / 10) % 2})
    c = e.groupBy("subject", "half").agg(*[F.avg(covariance(i, j)).alias(f"c{i}{j}") for i, j in COV2])
    pair = c.select("subject", F.array(F.array("c00", "c01"), F.array("c01", "c11")).alias("m"))
    got = means.riemannian_means(pair, ["subject"], parts=2)
    return rounded(got.select("subject", *[F.col("mean")[k].alias(n) for k, n in ((0, "m00"), (1, "m01"), (3, "m11"))]))


@query(f"""WITH {CHANNELS}, c AS (SELECT vec_id, {', '.join(f'{cov_sql(i, j)} AS c{i}{j}' for i, j in COV2)} FROM e), m AS (SELECT *, (c00 + c11) / 2 AS mu, (c00 * c00 + 2 * c01 * c01 + c11 * c11) / 4 AS sq FROM c),
 w AS (SELECT *, CASE WHEN sq - mu * mu / 2 > 0 THEN least(1.0::DOUBLE, (sq + mu * mu) / (17 * (sq - mu * mu / 2))) ELSE 1.0::DOUBLE END AS w FROM m), o AS (SELECT vec_id, (1 - w) * c00 + w * mu + 1e-10 AS a, (1 - w) * c01 AS b, (1 - w) * c11 + w * mu + 1e-10 AS c FROM w),
 v AS (SELECT vec_id, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS one, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS two FROM o)
SELECT vec_id, round(sqrt(ln(one) * ln(one) + ln(two) * ln(two)), 6) AS norm FROM v""")
def tangent_norm_pair(spark, d):
    """tangent_norm of the first two channels, of which eigenvalues have a closed form."""
    return tangent_norms(sources.epochs(spark, d).select("vec_id", F.slice("x", 1, 2).alias("x")))


def predicted(spark, d, aligned: bool = False) -> DataFrame:
    return runner.run(epoch_trials(spark, d), MODES, [0, 2, 5], 2, SEED, aligned=aligned)


@query()
def condition_runs(spark, d):
    """Six metrics of every fitted condition of the three methods."""
    return rounded(metrics.binary_metrics(predicted(spark, d).filter("error is null"), REPEAT))


@query()
def aligned_condition_runs(spark, d):
    return rounded(metrics.binary_metrics(predicted(spark, d, True).filter("error is null"), REPEAT))


@query()
def shuffled_label_control(spark, d):
    """Mean, least and greatest area under the curve by method, if labels are dealt anew by a hash: chance is a half."""
    t = epoch_trials(spark, d).withColumn("label", F.pmod(F.xxhash64(F.lit(SEED), "trial_uid"), F.lit(2)).cast("int"))
    m = metrics.binary_metrics(runner.run(t, MODES, [0, 5], 2, SEED), REPEAT)
    return rounded(m.groupBy("method").agg(F.avg("roc_auc").alias("mean"), F.min("roc_auc").alias("low"), F.max("roc_auc").alias("high")))


@query()
def mixed_lm_terms(spark, d):
    return rounded(mixed.terms(summary(spark, d), "roc_auc", MODES, ["subject", "source_plus_target"]))


@query()
def random_intercept_terms(spark, d):
    return rounded(mixed.terms(summary(spark, d), "roc_auc", MODES, ["subject", "source_plus_target"], slopes=False))


@query(f"""WITH {PAIR}, v AS (SELECT method, budget, count(*) AS n, avg(difference) AS mean, median(difference) AS median, list(difference ORDER BY dataset || '::' || target_subject) AS v FROM d GROUP BY ALL),
 bm AS (SELECT method, budget, list_sum([v[1 + CAST(('0x' || substr(md5('{SEED}:' || b || ':' || i), 1, 8)) AS BIGINT) % len(v)] FOR i IN range(1, len(v) + 1)]) / len(v) AS m FROM v, (SELECT unnest(range(1, 2001)) AS b) r),
 ci AS (SELECT method, budget, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM bm GROUP BY ALL)
SELECT v.method, v.budget, n, round(mean, 6) + 0.0::DOUBLE AS mean, round(median, 6) + 0.0::DOUBLE AS median, round(low, 6) + 0.0::DOUBLE AS ci_low, round(high, 6) + 0.0::DOUBLE AS ci_high FROM v JOIN ci USING (method, budget)""")
def mean_trajectory(spark, d):
    """Paired difference at every positive budget with a seeded interval."""
    x = curves.paired(summary(spark, d), "regime", "subject", "source_plus_target", ["method", "budget", "dataset", "target_subject"], "roc_auc").withColumn("id", F.concat_ws("::", "dataset", "target_subject"))
    mean = x.groupBy("method", "budget").agg(F.count("*").alias("n"), F.avg("difference").alias("mean"), F.median("difference").alias("median"))
    return rounded(mean.join(curves.hash_bootstrap(x, ["method", "budget"], "difference", "id", 2000, SEED), ["method", "budget"]))
