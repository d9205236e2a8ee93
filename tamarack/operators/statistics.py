"""Paired tests with families, exact p-values, and the comparison of runs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from tamarack.operators import curves

#: Up to so many differences without zeros and ties, the signed-rank p-value is exact.
EXACT = 50


def exact_p(n: int, statistic: float) -> float:
    """Two-sided signed-rank p-value: the share of the 2^n sign patterns whose rank sum is as small, twice, at most 1."""
    ways = np.ones(1)
    for rank in range(1, n + 1):
        longer = np.concatenate([ways, np.zeros(rank)])
        longer[rank:] += ways
        ways = longer
    return min(1.0, 2 * float(ways[: math.floor(statistic) + 1].sum() / 2.0**n))


@pandas_udf(DoubleType())
def signed_rank_p(n: pd.Series, statistic: pd.Series, ties: pd.Series, zeros: pd.Series, abs_z: pd.Series) -> pd.Series:
    """Exact where that is defined and small; else normal with tie correction. Few rows: one for each test."""
    out = []
    for k, w, t, z0, z in zip(n, statistic, ties, zeros, abs_z, strict=True):
        if not k:
            out.append(1.0)
        elif k <= EXACT and t == 0 and z0 == 0:
            out.append(exact_p(int(k), w))
        else:
            out.append(math.erfc(z / math.sqrt(2)))
    return pd.Series(out)


def tests(d: DataFrame, keys: list[str], value: str = "difference") -> DataFrame:
    """n, mean, median, statistic, p, rank_biserial of each key's differences. All zero: statistic 0, p 1, rank_biserial 0."""
    d = d.filter(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("difference", F.col(value))
    base = d.groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.avg("difference").alias("mean"), F.median("difference").alias("median"), F.count_if(F.col("difference") == 0).alias("zeros"))
    got = base.join(curves.signed_ranks(d, keys), keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    p = signed_rank_p(F.coalesce("n", F.lit(0)), zero("statistic"), zero("ties"), "zeros", zero("abs_z"))
    return got.select(*keys, "n_pairs", "mean", "median", zero("statistic").alias("statistic"), p.alias("p"), zero("rank_biserial").alias("rank_biserial"))


def family(kind: str, scope: Column) -> list[Column]:
    """family and inference_role of a test in a scope; each family is corrected alone."""
    whole = scope == "ALL"
    return [F.when(whole, f"{kind}_confirmatory").otherwise(f"{kind}_dataset_supportive").alias("family"), F.when(whole, "confirmatory").otherwise("supportive").alias("inference_role")]


def regime_family(summary: DataFrame, budgets: list[int], metric: str) -> DataFrame:
    """source_plus_target less subject, for each method, budget and scope."""
    d = curves.paired(summary.filter(F.col("budget").isin(budgets)), "regime", "subject", "source_plus_target", ["method", "budget", "dataset", "target_subject"], metric)
    t = tests(curves.scoped(d), ["method", "budget", "scope"])
    return curves.holm(t.select("*", *family("regime", F.col("scope"))), "family", "p", ["method", "budget", "scope"])


def method_family(areas: DataFrame, left: str = "csp_lda", right: str = "riemann_lr") -> DataFrame:
    """right less left in area under complete curves, for each regime and scope."""
    d = curves.paired(areas.filter("curve_complete"), "method", left, right, ["regime", "dataset", "target_subject"], "aucc")
    t = tests(curves.scoped(d), ["regime", "scope"])
    return curves.holm(t.select("*", *family("aucc", F.col("scope"))), "family", "p", ["regime", "scope"])


WEIGHTING = {"ALL": "participant-weighted over datasets"}


def contrasts(summary: DataFrame, areas: DataFrame | None, c, ci: bool = True) -> DataFrame:
    """The stored table of paired tests of a configuration: source_plus_target less subject at each pairwise budget, and riemann_lr less csp_lda in areas of
    complete curves; by scope, with seeded intervals, and Holm's correction in each family."""
    from tamarack.operators import bootstrap

    seed, metric, analysis = c["experiment"]["seed"], c["metrics"]["primary"], c["analysis"]
    size, level = analysis["bootstrap_resamples"], analysis["ci_level"]
    d = curves.scoped(curves.paired(summary.filter(F.col("budget").isin(analysis["pairwise_budgets"])), "regime", "subject", "source_plus_target", ["method", "budget", "dataset", "target_subject"], metric))

    def shaped(d: DataFrame, keys: list[str], kind: str, seeds, contrast: str, of: str, method: tuple) -> DataFrame:
        t = tests(d, keys)
        if ci:
            t = t.join(bootstrap.intervals(d, ["scope", *[k for k in keys if k != "scope"]], "difference", size, level, seeds).drop("estimate", "n_values"), keys)
        else:
            t = t.withColumns({"ci_lower": F.lit(None).cast("double"), "ci_upper": F.lit(None).cast("double")})
        text = F.when(F.col("scope") == "ALL", WEIGHTING["ALL"]).otherwise("within one dataset")
        own = [F.col(k) if k in keys else F.lit(None).cast(kind_) .alias(k) for k, kind_ in (("budget", "int"), ("regime", "string"))]
        return t.select(*family(kind, F.col("scope")), text.alias("scope_weighting"), F.col("scope").alias("scope_dataset"), F.lit(of).alias("metric"), F.lit(contrast).alias("contrast"), *own, *[x.alias(n) for x, n in zip(method, ("method_left", "method_right"), strict=True)], "n_pairs", "mean", "median", "ci_lower", "ci_upper", "statistic", "p", "rank_biserial")

    out = shaped(d, ["method", "budget", "scope"], "regime", bootstrap.paired_seed(seed, metric), "source_plus_target - subject", metric, (F.col("method"), F.col("method")))
    if areas is not None:
        e = curves.scoped(curves.paired(areas.filter("curve_complete"), "method", "csp_lda", "riemann_lr", ["regime", "dataset", "target_subject"], "aucc"))
        out = out.unionByName(shaped(e, ["regime", "scope"], "aucc", bootstrap.paired_seed(seed, metric, "paired-aucc"), "riemann_lr - csp_lda", f"aucc_{metric}", (F.lit("riemann_lr"), F.lit("csp_lda"))))
    return curves.holm(out, "family", "p", ["scope_dataset", "method_left", "budget", "regime"])


def trajectory(summary: DataFrame, c) -> DataFrame:
    """source_plus_target less subject at every positive budget, with seeded intervals and no p-values."""
    from tamarack.operators import bootstrap

    metric, analysis = c["metrics"]["primary"], c["analysis"]
    d = curves.scoped(curves.paired(summary.filter("budget > 0"), "regime", "subject", "source_plus_target", ["method", "budget", "dataset", "target_subject"], metric))
    keys = ["scope", "method", "budget"]
    t = d.groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.avg("difference").alias("mean"), F.median("difference").alias("median"))
    ci = bootstrap.intervals(d, keys, "difference", analysis["bootstrap_resamples"], analysis["ci_level"], bootstrap.paired_seed(c["experiment"]["seed"], metric, "ea-trajectory"))
    return t.join(ci.drop("estimate", "n_values"), keys).withColumnRenamed("scope", "scope_dataset").withColumn("metric", F.lit(metric))


def relabelled(t: DataFrame, families: dict[str, str], roles: dict[str, str] | str, classification: str) -> DataFrame:
    """Tests under other family names and roles; names that are not in the map stay. A family that still says confirmatory raises."""
    named = lambda column, of: F.coalesce(*[F.when(F.col(column) == k, v) for k, v in of.items()], F.col(column))
    role = F.lit(roles) if isinstance(roles, str) else named("inference_role", roles)
    new = named("family", families)
    checked = F.when(F.lower(new).contains("confirmatory"), F.raise_error(F.concat(F.lit("still confirmatory: "), new)).cast("string")).otherwise(new)
    return t.withColumn("family", checked).withColumn("inference_role", role).withColumn("classification", F.lit(classification))


#: Families of an aligned run, and of a run without one dataset; neither confirms anything.
ALIGNED = {"regime_confirmatory": "aligned_regime_exploratory", "regime_dataset_supportive": "aligned_regime_dataset_descriptive", "aucc_confirmatory": "aligned_aucc_exploratory", "aucc_dataset_supportive": "aligned_aucc_dataset_descriptive"}
WITHOUT = {"regime_confirmatory": "regime_without_dataset_robustness", "regime_dataset_supportive": "regime_without_dataset_supportive", "aucc_confirmatory": "aucc_without_dataset_robustness", "aucc_dataset_supportive": "aucc_without_dataset_supportive"}
WITHOUT_ROLES = {"confirmatory": "robustness_check_pooled", "supportive": "robustness_check_dataset_supportive"}


def without(df: DataFrame, dataset: str, participants: int | None = None) -> DataFrame:
    """df without a dataset. With participants, any other number of them left raises, when the rows are read."""
    rest = df.filter(F.col("dataset") != dataset)
    if participants is None:
        return rest
    n = rest.select("dataset", "target_subject").distinct().agg(F.count("*")).scalar()
    wrong = F.raise_error(F.concat(F.lit("participants left: "), n.cast("string"))).cast("boolean")
    return rest.filter(F.when(n == participants, True).otherwise(wrong))


def structures(primary: DataFrame, other: DataFrame) -> DataFrame:
    """term, and both models' estimates and errors, by term of either; marked: interactions of budget and regime alone."""
    own = lambda d, n: d.select("term", *[F.col(c).alias(f"{n}_{c}") for c in ("estimate", "se")])
    both = own(primary, "primary").join(own(other, "random_intercept_only"), "term", "full_outer")
    return both.withColumn("is_regime_by_budget", F.coalesce(F.col("term").rlike(r"^log2_budget\*regime:[^*]+$"), F.lit(False)))


def excludes_zero(low: Column, high: Column) -> Column:
    return (low > 0) | (high < 0)


def trajectories(**runs: DataFrame) -> DataFrame:
    """Rows of several runs under their names: source, method, budget, mean, ci_lower, ci_upper."""
    out = None
    for name, t in runs.items():
        own = t.select(F.lit(name).alias("source"), "method", "budget", "mean", "ci_lower", "ci_upper")
        out = own if out is None else out.unionByName(own)
    return out


def cross_run(primary: DataFrame, other: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys of either run, both values, their difference, whether their signs agree, and which is larger in magnitude."""
    a, b = primary.select(*keys, F.col(value).alias("primary")), other.select(*keys, F.col(value).alias("other"))
    x, y = F.col("primary"), F.col("other")
    return a.join(b, keys, "full_outer").select(
        *keys, "primary", "other", (y - x).alias("change"), (F.signum(x) == F.signum(y)).alias("direction_consistent"),
        F.when(F.abs(y) > F.abs(x), "increased").when(F.abs(y) < F.abs(x), "decreased").when(x.isNotNull() & y.isNotNull(), "unchanged").alias("magnitude_change"),
    )
