"""The appending sink: one file and one header after several jobs; a failed one leaves it as it was."""

import csv
import gzip
import os

import pytest
from pyspark.sql import functions as F

from tamarack import sources
from tamarack.sources import appended

COLUMNS = "k long, name string, score double, right boolean"


def rows_of(path, zipped):
    with (gzip.open if zipped else open)(path, "rt", newline="", encoding="utf-8") as f:
        return list(csv.reader(f))


@pytest.mark.parametrize("zipped", [True, False])
def test_appends_and_a_failure(spark, tmp_path, zipped):
    path = str(tmp_path / ("a.csv.gz" if zipped else "a.csv"))
    one = spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit('quote " comma, é '), "id").alias("name"), (F.col("id") / 7).alias("score"), (F.col("id") % 2 == 0).alias("right"), F.lit("x").alias("extra"))
    appended.append(one.repartitionByRange(4, "k"), path, ["k", "name", "score", "right"], zipped)
    first = rows_of(path, zipped)
    bad = one.withColumn("score", F.when(F.col("k") == 900, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("score")))
    with pytest.raises(Exception, match="broken"):
        appended.append(bad.repartitionByRange(4, "k"), path, ["k", "name", "score", "right"], zipped)
    assert rows_of(path, zipped) == first and os.listdir(tmp_path) == [os.path.basename(path)]
    appended.append(spark.createDataFrame([(7, None, float("nan"), None), (8, "line\nbreak", 1e-300, True)], COLUMNS).coalesce(1), path, zipped=zipped)
    appended.append(spark.createDataFrame([], COLUMNS), path, zipped=zipped)
    got = rows_of(path, zipped)
    assert got[0] == ["k", "name", "score", "right"] and got.count(got[0]) == 1 and len(got) == 1003
    assert [int(r[0]) for r in got[1:1001]] == list(range(1000)) and all(float(r[2]) == int(r[0]) / 7 for r in got[1:1001])
    assert got[1001][1:] == ["", "nan", ""] and got[1002][1] == "line\nbreak" and float(got[1002][2]) == 1e-300
    with pytest.raises(Exception, match="other columns"):
        appended.append(one, path, ["k", "score"], zipped)
    with pytest.raises(Exception, match="lack"):
        appended.append(one, path, ["k", "missing"], zipped)
    assert rows_of(path, zipped) == got and os.listdir(tmp_path) == [os.path.basename(path)]


def test_spark_reads_the_members(spark, tmp_path):
    path = str(tmp_path / "d.csv.gz")
    for k in range(3):
        appended.append(spark.range(k * 100, k * 100 + 100, 1, 3).select(F.col("id").alias("k"), F.lit("a b").alias("name"), (F.col("id") / 7).alias("score"), F.lit(True).alias("right")), path)
    back = sources.read_csv(spark, path, COLUMNS)
    assert back.count() == 300 and back.filter("score = k / 7 and right and name = 'a b'").count() == 300
    assert [r.k for r in back.collect()] == list(range(300))


def test_an_empty_job_makes_no_file(spark, tmp_path):
    appended.append(spark.createDataFrame([], COLUMNS), str(tmp_path / "b.csv.gz"))
    assert os.listdir(tmp_path) == []


def test_two_jobs_at_once_do_not_lose_rows(tmp_path):
    """What another job appended between a job's start and its commit is not written over."""
    writer = appended.AppendWriter({"path": str(tmp_path / "c.csv"), "gzip": "false"}, ["k"])
    os.makedirs(writer.staged)
    part = f"{writer.staged}/0"
    with open(part, "w") as f:
        f.write("1\n")
    (tmp_path / "c.csv").write_text('"k"\n2\n')
    with pytest.raises(RuntimeError, match="meanwhile"):
        writer.commit([appended.Part(0, part, 1)])
    writer.abort([])
    assert (tmp_path / "c.csv").read_text() == '"k"\n2\n' and not os.path.exists(writer.staged)
