"""The tables of a run: fixed columns and keys, written whole or appended once, read by schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack import sources
from tamarack.sources import METRICS, files

#: The columns of each table, in order.
_CONDITION = "dataset string, target_subject string, repeat int, method string, regime string, budget_per_class int"
_METRICS = ", ".join(f"{c} double" for c in METRICS)
_UID = "trial_uid string, session string, run string"
TABLES = {
    "metrics": f"{_CONDITION}, calibration_trials_total int, source_subject_count int, source_trials int, train_trials int, test_trials int, split_strategy string, split_id string, "
    f"condition_seed long, duplicate_of_population boolean, fit_shared_across_repeats boolean, status string, error_type string, error_message string, fit_seconds double, predict_seconds double, {_METRICS}",
    "predictions": f"{_CONDITION}, split_strategy string, split_id string, condition_seed long, {_UID}, y_true int, y_score double, y_pred int",
    "failures": f"{_CONDITION}, split_id string, error_type string, error_message string, traceback string",
    "split_assignments": f"dataset string, target_subject string, repeat int, split_strategy string, split_id string, {_UID}, group_id string, label int, role string",
    "calibration_assignments": f"dataset string, target_subject string, repeat int, split_id string, budget_per_class int, {_UID}, group_id string, label int, selected_at_budget int",
    "source_selection": "dataset string, target_subject string, source_subject string, selection_seed long, selected_trials int, class_0_trials int, class_1_trials int, selected_trial_uid_sha256 string",
    "source_trial_assignments": f"dataset string, target_subject string, source_subject string, selection_seed long, {_UID}, label int",
    "source_alignment_provenance": "dataset string, target_subject string, source_subject string, selection_seed long, source_trial_count int, source_alignment_reference_sha256 string, alignment_config_digest string",
    "target_alignment_provenance": "dataset string, target_subject string, repeat int, split_id string, budget_per_class int, target_calibration_trial_count int, "
    "target_calibration_trial_uid_sha256 string, target_alignment_reference_sha256 string, alignment_config_digest string",
}
ASSIGNMENTS = ("split_assignments", "calibration_assignments", "source_selection", "source_trial_assignments")
CONDITION = ["dataset", "target_subject", "repeat", "method", "regime", "budget_per_class", "split_id"]
SPLIT = ["dataset", "target_subject", "repeat", "split_id"]
#: Aligned runs say so in these tables.
ALIGNED = {"metrics", "predictions"}


def columns(name: str, aligned: bool = False) -> list[tuple[str, str]]:
    own = [tuple(c.strip().split(" ")) for c in TABLES[name].split(",")]
    return [*own, ("alignment_mode", "string")] if aligned and name in ALIGNED else own


def shaped(df: DataFrame, name: str, aligned: bool = False) -> DataFrame:
    """Exactly the table's columns; one that df lacks is null."""
    return df.select(*[(F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in columns(name, aligned)])


def exists(spark: SparkSession, out: str, name: str) -> bool:
    return files.exists(spark, f"{out}/{name}/_SUCCESS")


def read(spark: SparkSession, out: str, name: str, aligned: bool = False) -> DataFrame:
    """The table by its schema; one that lacks raises, and so does a column that lacks."""
    if not exists(spark, out, name):
        raise FileNotFoundError(f"{out}/{name}")
    found = spark.read.parquet(f"{out}/{name}")
    want = columns(name, aligned)
    if missing := [c for c, _ in want if c not in found.columns]:
        raise ValueError(f"{name}: missing columns {missing}")
    return found.select(*[F.col(c).cast(t).alias(c) for c, t in want])


def read_or_empty(spark: SparkSession, out: str, name: str, aligned: bool = False) -> DataFrame:
    if exists(spark, out, name):
        return read(spark, out, name, aligned)
    return spark.createDataFrame([], ", ".join(" ".join(c) for c in columns(name, aligned)))


def append(df: DataFrame, out: str, name: str, keys: list[str], aligned: bool = False) -> None:
    """Appends the rows whose keys the table has not. A key of which the table has some rows, but not as many as df, raises before anything is
    written."""
    spark = df.sparkSession
    rows = shaped(df, name, aligned)
    if exists(spark, out, name):
        old = read(spark, out, name, aligned)
        rows = sources.append_once(rows.join(rows.groupBy(*keys).agg(F.count("*").alias("n_expected")), keys), old, keys).select(*[c for c, _ in columns(name, aligned)])
    rows.write.mode("append").parquet(f"{out}/{name}")


def inside(df: DataFrame) -> DataFrame:
    """A stored table under the names of the operators."""
    return df.withColumnRenamed("budget_per_class", "budget")


def outside(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("budget", "budget_per_class")
