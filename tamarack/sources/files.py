"""Small files beside tables, through the file system that Spark sees: texts, JSON manifests, checksums."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _at(spark, path)
    return system.exists(at)


def read_text(spark: SparkSession, path: str) -> str:
    return read_bytes(spark, path).decode()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Whole or not at all: a temporary file is renamed."""
    at, system = _at(spark, path)
    temporary, _ = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    system.mkdirs(at.getParent())
    stream = system.create(temporary, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if system.exists(at):
        system.delete(at, False)
    if not system.rename(temporary, at):
        raise OSError(f"{path} could not be written")


def remove(spark: SparkSession, path: str) -> None:
    at, system = _at(spark, path)
    system.delete(at, True)


def replace_table(df: DataFrame, path: str) -> None:
    """df as a CSV folder with a header, whole or not at all: it is written beside, then renamed."""
    spark = df.sparkSession
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    df.coalesce(1).write.option("header", True).option("nullValue", "").csv(temporary)  # tables of reports are small
    at, system = _at(spark, path)
    if system.exists(at):
        system.delete(at, True)
    if not system.rename(_at(spark, temporary)[0], at):
        raise OSError(f"{path} could not be written")


def digest(spark: SparkSession, path: str) -> str:
    """One SHA-256 for a file, or for the sorted names and checksums of a folder's data files."""
    at, system = _at(spark, path)
    if not system.getFileStatus(at).isDirectory():
        found = hashed(listing(spark, path)).first()
        return found.sha256 if found else hashlib.sha256(b"").hexdigest()
    rows = hashed(listing(spark, path).filter("not file rlike '(^|/)[._]'")).select(F.struct("file", "sha256").alias("x"))
    return rows.agg(F.sha2(F.to_json(F.array_sort(F.collect_list("x"))), 256)).first()[0]  # a row for each file


def read_bytes(spark: SparkSession, path: str) -> bytes:
    at, system = _at(spark, path)
    stream = system.open(at)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True, default=plain) + "\n")


def plain(value: Any) -> Any:
    """What JSON lacks: NumPy values, and objects with fields."""
    if hasattr(value, "tolist"):
        return value.tolist()
    if hasattr(value, "asDict"):
        return value.asDict(recursive=True)
    if hasattr(value, "values") and isinstance(value.values, dict):
        return value.values
    return str(value)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """file (below path), path, bytes of the files of a folder, or of one file; their content is not read. Empty files are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))
    root, _ = _at(spark, path)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    name = F.regexp_replace(F.regexp_replace("path", "^([a-z0-9]+:)/+", "$1/"), "^" + root.replace("///", "/").replace("//", "/").replace(".", r"\.") + "/", "")
    return found.select(name.alias("file"), "path", "bytes")


#: Bytes that are hashed in one go. A longer file's checksum is that of its pieces' checksums, so that its pieces can be hashed side by side.
PIECE, STEP = 1 << 28, 1 << 22


def opened(path: str):
    """A file that pyarrow reads: local, or of any store that it knows by the address."""
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def hashed(listed: DataFrame, piece: int = PIECE) -> DataFrame:
    """file, sha256, bytes of listed files, read in steps; of any size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, start, size in zip(b["path"], b["start"], b["bytes"], strict=True):
                h, end = hashlib.sha256(), min(start + piece, size)
                with opened(path) as f:
                    for at in range(start, end, STEP):
                        h.update(f.read_at(min(STEP, end - at), at))
                out.append(h.hexdigest())
            yield pd.DataFrame({"file": b["file"], "bytes": b["bytes"], "start": b["start"], "own": out})

    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(piece).cast("long"))
    pieces = listed.withColumn("start", F.explode(starts)).repartition(F.col("path"), F.col("start"))
    own = pieces.select("file", "path", "bytes", "start").mapInPandas(run, "file string, bytes long, start long, own string")
    g = own.groupBy("file", "bytes").agg(F.array_sort(F.collect_list(F.struct("start", "own"))).alias("p"))  # a file's pieces
    return g.select("file", F.when(F.size("p") == 1, F.col("p")[0]["own"]).otherwise(F.sha2(F.array_join(F.col("p.own"), ""), 256)).alias("sha256"), "bytes")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """file (below path), sha256, bytes of the files of a folder; computed where the files are read."""
    return hashed(listing(spark, path))
