"""Sources, sinks and expressions that queries don't reach, and what they refuse."""

import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tamarack import functions as fn
from tamarack import provenance, sources
from tamarack.operators import statistics
from tamarack.sources import archive, files, shards
from tamarack.streaming import append_new


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.1 + 0.2, 1), ("b", 1e-17, None)], "k string, x double, n int")
    path = str(tmp_path / "t")
    for _ in range(2):
        sources.write_csv(rows, path, ["k", "x"])
    got = sources.read_csv(spark, path, "k string, x double").collect()
    assert sorted((r.k, r.x) for r in got) == sorted(2 * [("a", 0.1 + 0.2), ("b", 1e-17)])
    both = tmp_path / "joined.csv.gz"
    both.write_bytes(gzip.compress(b"k,x\na,1.5\n") + gzip.compress(b"b,2.5\n"))
    assert {(r.k, r.x) for r in sources.read_csv(spark, str(both), "k string, x double").collect()} == {("a", 1.5), ("b", 2.5)}
    (tmp_path / "bad.csv").write_text("k,x\na,one\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        sources.read_csv(spark, str(tmp_path / "bad.csv"), "k string, x double").collect()


def test_part_of_a_condition_is_refused(spark, tmp_path):
    new = spark.createDataFrame([(1, k) for k in range(3)] + [(2, k) for k in range(3)], "c int, t int").withColumn("n_expected", F.lit(3))
    assert {r.c for r in sources.append_once(new, new.filter("c = 1"), ["c"]).collect()} == {2}
    with pytest.raises(Exception, match="partial append"):
        sources.append_once(new, new.filter("c = 1 and t < 2"), ["c"]).collect()
    rows = new.select("c", "t")
    for n, part in enumerate((rows.filter("c = 1 and t < 2"), rows)):
        part.write.parquet(str(tmp_path / f"in{n}"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / f"in{n}"))
        query = append_new(stream, str(tmp_path / "out"), str(tmp_path / f"check{n}"), ["c"], ["c", "t"])
        if n:
            with pytest.raises(Exception, match="partial append"):
                query.awaitTermination(60)
        else:
            query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_expressions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(fn.normal_id(F.lit(x))) for x in ("3.0", " a ", "3.5", "12")] == ["3", "a", "3.5", "12"]
    assert one(fn.sigmoid(F.lit(0.0))) == 0.5 and 0 < one(fn.sigmoid(F.lit(-1e9))) < 1e-17
    assert [one(fn.p_text(F.lit(x).cast("double"))) for x in (0.0001, 0.04, None)] == ["<0.001", "0.040", "--"]
    assert one(fn.tex_escape(F.lit("a_b 5% & #~"))) == r"a\_b 5\% \& \#\textasciitilde{}"
    assert one(fn.derive_seed(20260811, F.lit("D"), F.lit("1"), F.lit("split"))) == 775142910
    assert one(fn.derive_seed(1, F.lit('a"b'))) != one(fn.derive_seed(1, F.lit("ab")))
    assert [one(fn.holm_label(F.lit(x))) for x in (0.0004, 0.2)] == ["Holm p < 0.001", "Holm p = 0.200"] and one(fn.safe_name(F.lit("a/b c"))) == "a-b_c"
    assert [one(fn.encode_labels(F.lit(x), "left", "right")) for x in (" LEFT", "right ")] == [0, 1]
    with pytest.raises(Exception, match="up"):
        one(fn.encode_labels(F.lit("up"), "left", "right"))
    assert one(fn.subject_directory("r", F.lit("D"), F.lit("3.0"))) == "r/D/subject-3"


def test_subjects_asked_for(spark):
    assert shards.resolved(["10", "2", "x"], "all", [10]) == ["2", "x"] and shards.resolved(["1", "2"], [2, 1]) == ["2", "1"]
    with pytest.raises(ValueError, match="not available"):
        shards.resolved(["1"], [1, 3])
    with pytest.raises(ValueError, match="are left"):
        shards.resolved(["1", "2"], "all", [2], 2)


def test_adapters_are_pluggable(spark):
    archive.register(spark)
    got = spark.read.format("trials").option("subjects", "4").option("only", "2,4").option("per_class", "2").load()
    assert {r.subject for r in got.select("subject").distinct().collect()} == {"2", "4"} and got.count() == 16
    with pytest.raises(ValueError, match="already"):
        archive.adapter("synthetic")(archive._synthetic)
    with pytest.raises(Exception, match="no adapter"):
        spark.read.format("trials").option("adapter", "nowhere").load().count()


def test_files_and_digests(spark, tmp_path):
    path = str(tmp_path / "a" / "x.json")
    files.write_json(spark, path, {"b": 1, "a": F})
    files.write_json(spark, path, {"b": 2})
    assert files.read_json(spark, path) == {"b": 2} and files.digest(spark, path) == hashlib.sha256((tmp_path / "a" / "x.json").read_bytes()).hexdigest()
    for n in (1, 1, 2):
        files.replace_table(spark.range(n), str(tmp_path / "t.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t.csv")).count() == 2 and len(files.digest(spark, str(tmp_path / "t.csv"))) == 64


def test_provenance(tmp_path, monkeypatch):
    own = tmp_path / "somepackage"
    (own / "inner").mkdir(parents=True)
    (own / "__init__.py").write_text("")
    (own / "inner" / "x.py").write_text("a = 1\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    first = provenance.package_digest("somepackage")
    (own / "inner" / "notes.txt").write_text("not a module")
    assert provenance.package_digest("somepackage") == first
    (own / "inner" / "x.py").write_text("a = 2\n")
    assert provenance.package_digest("somepackage") != first and provenance.package_digest() == provenance.package_digest()
    assert provenance.revision(str(tmp_path)) is None and provenance.revision(str(tmp_path / "none")) is None
    assert provenance.environment()["status"] == "ok" and not provenance.unmet()
    monkeypatch.setattr(provenance, "REQUIREMENTS", (provenance.Requirement("numpy", "1.0", "1.5"), provenance.Requirement("nowhere", "1", "2", "m")))
    assert len(provenance.unmet()) == 1 and "numpy" in provenance.unmet()[0] and len(provenance.unmet(["m"])) == 2
    assert provenance.environment()["status"] == "failed"


def test_without_a_dataset(spark):
    s = spark.createDataFrame([("A", "1"), ("A", "2"), ("B", "1")], "dataset string, target_subject string")
    assert statistics.without(s, "B", 2).count() == 2
    with pytest.raises(Exception, match="participants left"):
        statistics.without(s, "B", 3).collect()
    t = spark.createDataFrame([("log2_budget*regime:subject", 1.0, 0.1), ("intercept", 2.0, 0.2), ("log2_budget*method:m*regime:subject", 3.0, 0.1)], "term string, estimate double, se double")
    got = {r.term: (r.primary_estimate, r.random_intercept_only_estimate, r.is_regime_by_budget) for r in statistics.structures(t, t.filter("estimate < 3")).collect()}
    assert got == {"log2_budget*regime:subject": (1.0, 1.0, True), "intercept": (2.0, 2.0, False), "log2_budget*method:m*regime:subject": (3.0, None, False)}
    with pytest.raises(Exception, match="still confirmatory"):
        statistics.relabelled(s.withColumns({"family": F.lit("x_confirmatory"), "inference_role": F.lit("")}), {}, "exploratory", "c").collect()


def test_long_files_are_hashed_in_pieces(spark, tmp_path):
    content = bytes(range(256)) * 40_000
    for name, own in (("a.bin", content), ("b.bin", b""), ("inner/c.bin", b"xyz")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(own)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.file: (r.sha256, r.bytes) for r in files.hashed(files.listing(spark, str(tmp_path)), 3_000_000).collect()}
    pieces = "".join(sha(content[k : k + 3_000_000]) for k in range(0, len(content), 3_000_000))
    assert got == {"a.bin": (sha(pieces.encode()), len(content)), "inner/c.bin": (sha(b"xyz"), 3)}
    assert files.digest(spark, str(tmp_path / "a.bin")) == sha(content) and files.digest(spark, str(tmp_path / "b.bin")) == sha(b"")


def test_a_second_save_reads_no_saved_file(spark, tmp_path):
    from tamarack.sources import synthetic

    root, t = str(tmp_path / "shards"), synthetic.trials(spark)
    shards.save(t.filter("subject <> '3'"), root, {"a": 1}, {})
    old = [str(p) for p in (tmp_path / "shards" / "trials").rglob("*.parquet")]
    for p in old:
        os.utime(p, (0, os.stat(p).st_mtime))
    shards.save(t, root, {"a": 1}, {})
    assert len(old) == 2 and all(os.stat(p).st_atime == 0 for p in old)
    assert len(shards.manifest(spark, root).collect()) == 3 and shards.changed(spark, root).count() == 0
    assert any(os.stat(p).st_atime > 0 for p in old) or not os.access("/proc/mounts", os.R_OK) or "noatime" in open("/proc/mounts").read()
    with open(old[0], "ab") as f:
        f.write(b"x")
    assert shards.changed(spark, root).count() == 1
