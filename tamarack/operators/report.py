"""Tables for publication from tests, models and curves: as rows, and as LaTeX or Markdown text of their few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack import functions as fn

RESULT = ["n_pairs", "mean", "ci_lower", "ci_upper", "p", "p_holm", "rank_biserial"]


def displayed(t: DataFrame) -> DataFrame:
    """Tests with what a reader sees: method_display, budget_or_regime."""
    method = F.when(F.col("method_left") == F.col("method_right"), F.col("method_left")).otherwise(F.concat_ws(" vs ", "method_left", "method_right"))
    at = F.when(F.col("budget").isNotNull(), F.concat(F.col("budget").cast("string"), F.lit(" trials/class"))).otherwise(F.concat(F.col("regime"), F.lit(" regime (AUCC)")))
    return t.withColumns({"method_display": method, "budget_or_regime": at})


def main_contrasts(t: DataFrame, regime: str = "subject") -> DataFrame:
    """The confirmatory contrasts: of regimes, and of methods under one regime."""
    whole = displayed(t).filter((F.col("family") == "regime_confirmatory") | ((F.col("family") == "aucc_confirmatory") & (F.col("regime") == regime)))
    return whole.select("family", "contrast", "budget_or_regime", "budget", "regime", "method_display", *RESULT)


def supportive_contrasts(t: DataFrame) -> DataFrame:
    """All contrasts within a dataset."""
    return displayed(t).filter("inference_role = 'supportive'").select("family", "scope_dataset", "contrast", "budget_or_regime", "method_display", *RESULT)


def is_variance(term: Column) -> Column:
    return term.isin("intercept_variance", "covariance", "slope_variance", "residual_variance")


def fixed_effects(terms: DataFrame, main: bool = False) -> DataFrame:
    """Fixed effects with readable labels and z; main: without interactions of methods."""
    rows = terms.filter(~is_variance(F.col("term")) & ~F.col("term").isin("log_likelihood", "not_estimated"))
    if main:
        rows = rows.filter(~(F.col("term").contains("*") & F.col("term").contains("method:")))
    label = F.regexp_replace(F.regexp_replace(F.regexp_replace("term", r"\*", " × "), "(method|regime|dataset):", "$1 "), "^log2_budget", "log2(budget + 1)")
    return rows.withColumns({"term_label": label, "z": F.try_divide("estimate", "se")})


def variance_components(terms: DataFrame) -> DataFrame:
    return terms.filter(is_variance(F.col("term")))


def small_cohort(curve: DataFrame, dataset: str, metric: str = "roc_auc") -> DataFrame:
    """The curves of one dataset, described and not tested: a panel for each regime."""
    panel = F.when(F.col("regime") == "subject", "A").otherwise("B")
    own = curve.filter((F.col("dataset") == dataset) & F.col("regime").isin("subject", "source_plus_target") & (F.col("metric") == metric))
    return own.withColumns({"x": F.log2(F.col("budget") + 1), "figure_panel": panel})


def curve_panels(curve: DataFrame, metric: str) -> DataFrame:
    """The rows of calibration-curve figures: x is log2(budget + 1)."""
    return curve.filter(F.col("metric") == metric).withColumn("x", F.log2(F.col("budget") + 1))


def interval_text(mean: Column, low: Column, high: Column, digits: int = 3) -> Column:
    n = lambda c: fn.number_text(c, digits)
    return F.concat(n(mean), F.lit(" ["), n(low), F.lit(", "), n(high), F.lit("]"))


def text_rows(df: DataFrame, columns: dict[str, str], tex: bool) -> DataFrame:
    """The columns as text: doubles to three places, p-values by their rule, other text escaped."""
    kinds = dict(df.dtypes)

    def one(c: str) -> Column:
        if c in ("p", "p_holm"):
            return F.concat(fn.p_text(F.col(c), tex), fn.significance(F.col(c)))
        if kinds[c] == "double":
            return fn.number_text(F.col(c))
        return F.coalesce(fn.tex_escape(F.col(c).cast("string")) if tex else F.col(c).cast("string"), F.lit("--"))

    return df.select(*[one(c).alias(title) for c, title in columns.items()])


def latex(df: DataFrame, columns: dict[str, str], caption: str, label: str, notes: tuple[str, ...] = ()) -> str:
    """A table of df's few rows in their order. columns: names and titles; caption and notes are LaTeX already."""
    rows = text_rows(df, columns, True).collect()  # a report's rows
    align = "".join("r" if dict(df.dtypes)[c] in ("double", "int", "bigint") else "l" for c in columns)
    body = [" & ".join(r) + r" \\" for r in rows]
    note = [r"\begin{tablenotes}", r"\footnotesize", *(rf"\item {n}" for n in notes), r"\end{tablenotes}"] if notes else []
    lines = [
        "% needs booktabs and threeparttable", r"\begin{table}[t]", r"\centering", r"\small", r"\begin{threeparttable}", rf"\caption{{{caption}}}", rf"\label{{{label}}}",
        rf"\begin{{tabular}}{{{align}}}", r"\toprule", " & ".join(columns.values()) + r" \\", r"\midrule", *body, r"\bottomrule", r"\end{tabular}", *note, r"\end{threeparttable}", r"\end{table}", "",
    ]
    text = "\n".join(lines)
    if r"\textbackslash{}textbackslash" in text:
        raise ValueError("text was escaped twice")
    return text


def markdown(df: DataFrame, columns: dict[str, str]) -> str:
    rows = text_rows(df, columns, False).collect()  # a report's rows
    return "\n".join("| " + " | ".join(r) + " |" for r in [tuple(columns.values()), ("---",) * len(columns), *rows]) + "\n"
