"""Prepared trials on disk: one folder of Parquet files for each dataset and subject, a manifest row for each, a manifest for each dataset.

Writing and checking are single plans over all subjects; a manifest is a table of one row a subject, small enough for JSON.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack import plans
from tamarack import functions as fn
from tamarack.sources import files

#: Fixed value: the version of what a shard holds.
VERSION = 1
IDS = ["subject", "session", "run", "trial_uid"]
MANIFEST = "dataset string, subject string, version int, trials long, channels int, samples int, class_counts map<string,long>, group_counts map<string,long>, preprocessing string, versions string, files map<string,string>"


def shard_rules(t: DataFrame) -> dict[str, DataFrame]:
    """What a trial table must hold: dataset, subject, session, run, trial_uid, label, x (channels of samples)."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    finite = F.forall("x", lambda c: F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    shape = F.struct(F.size("x").alias("channels"), F.size(F.get("x", F.lit(0))).alias("samples"))
    even = F.forall("x", lambda c: F.size(c) == F.size(F.get("x", F.lit(0))))
    whole = t.groupBy("dataset", "subject")
    return {
        "ids_present": t.filter(reduce(lambda a, b: a | b, map(blank, ["dataset", *IDS]))), "unique_trials": plans.duplicates(t, ["dataset", "subject", "trial_uid"]),
        "binary_label": t.filter("label is null or label not in (0, 1)"), "both_labels": whole.agg(F.countDistinct("label").alias("n")).filter("n <> 2"),
        "finite": t.filter(F.col("x").isNull() | ~F.coalesce(finite, F.lit(False))), "even_channels": t.filter(~F.coalesce(even, F.lit(False))),
        "one_shape": whole.agg(F.countDistinct(shape).alias("n")).filter("n <> 1"),
    }


def incompatible(t: DataFrame) -> DataFrame:
    """Datasets whose subjects differ in channels or samples."""
    shape = F.struct(F.size("x").alias("channels"), F.size(F.get("x", F.lit(0))).alias("samples"))
    return t.groupBy("dataset").agg(F.countDistinct(shape).alias("n")).filter("n > 1")


def counts(t: DataFrame) -> DataFrame:
    """dataset, subject, trials, channels, samples, class_counts, group_counts (by session::run)."""
    keys = ["dataset", "subject"]

    def mapped(of, name: str) -> DataFrame:
        return t.groupBy(*keys, of.alias("k")).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))

    size = t.groupBy(*keys).agg(F.count("*").alias("trials"), F.max(F.size("x")).alias("channels"), F.max(F.size(F.get("x", F.lit(0)))).alias("samples"))
    return size.join(mapped(F.col("label").cast("string"), "class_counts"), keys).join(mapped(F.concat_ws("::", "session", "run"), "group_counts"), keys)


def _manifest_path(root: str) -> str:
    return f"{root}/manifest"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The manifest rows of root; empty where nothing was saved."""
    path = _manifest_path(root)
    return spark.read.schema(MANIFEST).json(path) if files.exists(spark, path) else spark.createDataFrame([], MANIFEST)


def stored(spark: SparkSession, root: str) -> DataFrame:
    """dataset, subject, file, path, bytes of the saved trials; no file is read."""
    part = lambda n: F.url_decode(F.regexp_extract("file", rf"{n}=([^/]*)/", 1))
    return files.listing(spark, f"{root}/trials").filter("file like '%.parquet'").select(part("dataset").alias("dataset"), part("subject").alias("subject"), "file", "path", "bytes")


def _files(listed: DataFrame) -> DataFrame:
    """dataset, subject, file, sha256 of stored files."""
    return listed.select("dataset", "subject", "file").join(files.hashed(listed).select("file", "sha256"), "file")


def save(t: DataFrame, root: str, preprocessing: dict, versions: dict, overwrite: bool = False) -> DataFrame:
    """Saves the trials of new subjects and gives the manifest. A subject that is there already must have been saved with the same version,
    preprocessing and packages, and is left as it is; with overwrite it is replaced."""
    spark = t.sparkSession
    plans.gate(plans.audit(shard_rules(t)))
    keys, how = ["dataset", "subject"], [json.dumps(x, sort_keys=True) for x in (preprocessing, versions)]
    old = manifest(spark, root)  # not cached: a later reading of the path would be given this one
    mine = t.select(*keys).distinct()
    if not overwrite:
        unlike = old.join(mine, keys, "left_semi").filter((F.col("version") != VERSION) | (F.col("preprocessing") != how[0]) | (F.col("versions") != how[1]))
        if bad := unlike.select(*keys).limit(10).collect():
            raise ValueError(f"saved with another version, preprocessing or packages: {[tuple(x) for x in bad]}")
        t = t.join(old.select(*keys), keys, "left_anti")
    fresh = t.select(*keys).distinct().cache()
    if fresh.isEmpty():
        return old
    rows = t.select(*[F.col(c) for c in t.columns])
    (rows.repartition(*keys).sortWithinPartitions(*keys, "trial_uid").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{root}/trials"))
    found = _files(stored(spark, root).join(fresh, keys, "left_semi")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", "sha256")))).alias("files"))
    new = counts(t).join(found, keys).select("dataset", "subject", F.lit(VERSION).alias("version"), "trials", "channels", "samples", "class_counts", "group_counts", F.lit(how[0]).alias("preprocessing"), F.lit(how[1]).alias("versions"), "files")
    kept = old.join(fresh, keys, "left_anti").select(*new.columns)
    lines = sorted(r[0] for r in kept.unionByName(new).select(F.to_json(F.struct(*new.columns))).collect())  # a row for each subject
    files.write_text(spark, f"{_manifest_path(root)}/subjects.json", "\n".join(lines) + "\n")
    fresh.unpersist()
    return manifest(spark, root)


def changed(spark: SparkSession, root: str) -> DataFrame:
    """Files that differ from the manifest's checksums, lack, or are not listed."""
    listed = manifest(spark, root).select("dataset", "subject", F.explode("files").alias("file", "listed"))
    return listed.join(_files(stored(spark, root)), ["dataset", "subject", "file"], "full_outer").filter("not (listed <=> sha256)")


def load(spark: SparkSession, root: str, dataset: str | None = None, subjects: list[str] | None = None, verify: bool = False) -> DataFrame:
    """The saved trials; only the folders of the dataset and subjects asked for are read. With verify, a checksum that differs raises."""
    if verify and (bad := changed(spark, root).limit(5).collect()):
        raise ValueError(f"files differ from the manifest: {[x.file for x in bad]}")
    saved = manifest(spark, root)
    if bad := saved.filter(F.col("version") != VERSION).limit(5).collect():
        raise ValueError(f"saved by another version: {[(x.dataset, x.subject) for x in bad]}")
    t = spark.read.option("basePath", f"{root}/trials").parquet(f"{root}/trials")
    t = t.withColumns({c: F.col(c).cast("string") for c in ("dataset", "subject")})
    if dataset is not None:
        t = t.filter(F.col("dataset") == dataset)
    return t if subjects is None else t.filter(F.col("subject").isin([str(s) for s in subjects]))


def structure_differs(spark: SparkSession, root: str) -> DataFrame:
    """Subjects whose saved trials are not those that the manifest counts."""
    found = counts(load(spark, root)).withColumnsRenamed({c: f"{c}_" for c in ("trials", "channels", "samples", "class_counts", "group_counts")})
    both = manifest(spark, root).join(found, ["dataset", "subject"], "full_outer")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("trials", "channels", "samples")] + [F.map_entries(c).eqNullSafe(F.map_entries(f"{c}_")) for c in ("class_counts", "group_counts")]
    return both.filter(~reduce(lambda a, b: a & b, same)).select("dataset", "subject")


def prepared(spark: SparkSession, root: str, dataset: str) -> list[str]:
    """Saved subjects: numbers by value, then the others."""
    rows = manifest(spark, root).filter(F.col("dataset") == dataset).orderBy(fn.subject_key(F.col("subject"))).select("subject").collect()
    return [r.subject for r in rows]


def resolved(available: list[str], wanted: list | str, excluded: list = (), least: int = 1) -> list[str]:
    """The wanted subjects, or all, less the excluded ones. Those that lack, or too few left, raise."""
    number = lambda s: (not s.isdigit(), int(s) if s.isdigit() else 0, s)
    chosen = sorted(map(str, available), key=number) if wanted == "all" else [str(s) for s in wanted]
    if missing := sorted(set(chosen) - set(map(str, available)), key=number):
        raise ValueError(f"subjects are not available: {missing}")
    left = [s for s in chosen if s not in set(map(str, excluded))]
    if len(left) < least:
        raise ValueError(f"{least} subjects or more are needed, {len(left)} are left")
    return left


def dataset_manifest(spark: SparkSession, root: str, dataset: str, fingerprint: str) -> dict:
    """Writes and gives the dataset's manifest: its subjects, and the SHA-256 of each one's manifest row."""
    rows = manifest(spark, root).filter(F.col("dataset") == dataset)
    digests = dict(rows.select("subject", F.sha2(F.to_json(F.struct(*rows.columns)), 256)).collect())
    subjects = prepared(spark, root, dataset)
    out = {"version": VERSION, "dataset": dataset, "preprocessing_fingerprint": fingerprint, "subjects": subjects, "n_subjects": len(subjects), "subject_manifest_sha256": digests}
    files.write_json(spark, f"{root}/{dataset}.manifest.json", out)
    return out


def validate_dataset(spark: SparkSession, root: str, dataset: str, fingerprint: str, verify: bool = True) -> DataFrame:
    """One row a subject: sizes, classes, sessions, signal range. A manifest that differs from the configuration or the files raises."""
    path = f"{root}/{dataset}.manifest.json"
    if not files.exists(spark, path):
        raise FileNotFoundError(path)
    said = files.read_json(spark, path)
    if said["version"] != VERSION or said["preprocessing_fingerprint"] != fingerprint:
        raise ValueError(f"{dataset} was prepared by another version or preprocessing")
    rows = manifest(spark, root).filter(F.col("dataset") == dataset)
    now = dict(rows.select("subject", F.sha2(F.to_json(F.struct(*rows.columns)), 256)).collect())
    if now != said["subject_manifest_sha256"]:
        raise ValueError(f"{dataset}: subject manifests changed after the dataset's")
    t = load(spark, root, dataset, verify=verify)
    if not incompatible(t).isEmpty():
        raise ValueError(f"{dataset}: subjects differ in channels or samples")
    ptp = F.explode(F.transform("x", lambda c: (F.array_max(c) - F.array_min(c)) * 1e6)).alias("ptp")
    signal = t.select("subject", ptp).groupBy("subject").agg(F.median("ptp").alias("median_peak_to_peak_uv"), F.max("ptp").alias("maximum_peak_to_peak_uv"))
    one = t.groupBy("dataset", "subject").agg(
        F.count("*").alias("trials"), *[F.count_if(F.col("label") == k).alias(f"class_{k}") for k in (0, 1)], F.countDistinct("session").alias("sessions"),
        F.countDistinct("session", "run").alias("runs"), F.max(F.size("x")).alias("channels"), F.max(F.size(F.get("x", F.lit(0)))).alias("samples"),
    )
    return one.join(signal, "subject")
