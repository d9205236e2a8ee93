"""Assignments of an earlier run: loaded, held against a fresh assignment before anything is fitted, and taken up again by trial ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack import plans
from tamarack.sources import files, results

TARGET = ["dataset", "target_subject"]


@dataclass(frozen=True)
class Reused:
    folder: str
    experiment_fingerprint: str | None
    git_commit: str | None
    sha256: dict[str, str]
    tables: dict[str, DataFrame]

    def report(self) -> dict:
        return {
            "primary_output_dir": self.folder, "primary_experiment_fingerprint": self.experiment_fingerprint, "primary_git_commit": self.git_commit,
            "reused_assignment_file_sha256": self.sha256,
        }


def load(spark: SparkSession, folder: str) -> Reused:
    """The four tables of a run, their checksums, and what its manifest says. A table or column that lacks raises."""
    tables = {name: results.read(spark, folder, name) for name in results.ASSIGNMENTS}
    path = f"{folder}/run_manifest.json"
    said = files.read_json(spark, path) if files.exists(spark, path) else {}
    return Reused(folder, said.get("experiment_fingerprint"), (said.get("git") or {}).get("commit"), {n: files.digest(spark, f"{folder}/{n}") for n in tables}, tables)


def differences(reused: dict[str, DataFrame], again: dict[str, DataFrame]) -> DataFrame:
    """table, n_reused, n_again, n_differing (rows that one side has more often, all values as text): a row for each table of reused."""
    out = None
    for name, own in reused.items():
        new, both = again[name].select(*own.columns), plans.unequal(own, again[name].select(*own.columns))
        row = plans.audit({"n_reused": own, "n_again": new, "n_differing": both}).groupBy().pivot("rule", ["n_reused", "n_again", "n_differing"]).agg(F.first("n_violations")).select(F.lit(name).alias("table"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def verified(reused: dict[str, DataFrame], again: dict[str, DataFrame]) -> dict:
    """A report of the rows compared. Any difference raises: nothing may be fitted then."""
    rows = differences(reused, again).collect()  # a row for each table
    if bad := {r.table: r.n_differing for r in rows if r.n_differing or r.n_reused != r.n_again}:
        raise AssertionError(f"reused assignments are not what is assigned afresh, so the run stops; rows that differ: {bad}")
    return {"status": "ok"} | {f"{r.table}_rows": r.n_reused for r in rows}


def positions(t: DataFrame) -> DataFrame:
    """dataset, subject, trial_uid, position: from 0, by session, run and the place in the run (trial_index, else trial_uid)."""
    at = "trial_index" if "trial_index" in t.columns else "trial_uid"
    line = Window.partitionBy("dataset", "subject").orderBy("session", "run", at)
    return t.select("dataset", "subject", "trial_uid", (F.row_number().over(line) - 1).alias("position"))


def unknown(assigned: DataFrame, t: DataFrame, subject: str = "target_subject") -> DataFrame:
    """Assigned trials that the subject, of the same dataset, has not; must be none."""
    return assigned.join(t.select("dataset", F.col("subject").alias(subject), "trial_uid"), ["dataset", subject, "trial_uid"], "left_anti")


def placed(assigned: DataFrame, t: DataFrame, subject: str = "target_subject") -> DataFrame:
    """assigned with each trial's position. Subjects are met by dataset and id, as ids recur in datasets. An unknown id raises."""
    found = assigned.join(positions(t).withColumnRenamed("subject", subject), ["dataset", subject, "trial_uid"], "left")
    lost = F.raise_error(F.concat(F.lit("no trial has the assigned id "), "trial_uid")).cast("int")
    return found.withColumn("position", F.coalesce("position", lost))


def splits(split: DataFrame, t: DataFrame) -> DataFrame:
    """dataset, target_subject, repeat, split_id, split_strategy, calibration_pool and test (sorted positions), calibration_groups, test_groups. A repeat of two splits raises."""
    rows = placed(split, t)
    of = lambda c, role: F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col(c))))
    g = rows.groupBy(*TARGET, "repeat").agg(
        F.collect_set(F.struct("split_id", "split_strategy")).alias("own"), of("position", "calibration_pool").alias("calibration_pool"), of("position", "test").alias("test"),
        of("group_id", "calibration_pool").alias("calibration_groups"), of("group_id", "test").alias("test_groups"),
    )
    two = F.raise_error(F.concat(F.lit("two splits of one repeat: "), F.concat_ws("::", *TARGET))).cast("struct<split_id:string,split_strategy:string>")
    return g.withColumn("own", F.when(F.size("own") == 1, F.get("own", F.lit(0))).otherwise(two)).select(*TARGET, "repeat", "own.*", "calibration_pool", "test", "calibration_groups", "test_groups")


def samples(calibration: DataFrame, t: DataFrame) -> DataFrame:
    """dataset, target_subject, repeat, split_id, budget_per_class, positions (sorted), class_0, class_1, nested: whether the sample holds the next smaller one."""
    g = placed(calibration, t).groupBy(*results.SPLIT, "budget_per_class").agg(F.array_sort(F.collect_set("position")).alias("positions"), F.count_if(F.col("label") == 0).alias("class_0"), F.count_if(F.col("label") == 1).alias("class_1"))
    before = F.lag("positions").over(Window.partitionBy(*results.SPLIT).orderBy("budget_per_class"))
    return g.withColumn("nested", F.coalesce(F.size(F.array_except(before, "positions")) == 0, F.lit(True)))


def sources(selection: DataFrame, detail: DataFrame, t: DataFrame) -> DataFrame:
    """dataset, target_subject, source_subject, positions (sorted) of the trials taken; a selected source without trials raises."""
    g = placed(detail, t, "source_subject").groupBy(*TARGET, "source_subject").agg(F.array_sort(F.collect_set("position")).alias("positions"))
    none = F.raise_error(F.concat(F.lit("a source has no trials: "), "source_subject")).cast("array<int>")
    return selection.select(*TARGET, "source_subject").join(g, [*TARGET, "source_subject"], "left").withColumn("positions", F.coalesce("positions", none))
