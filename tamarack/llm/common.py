"""What the operators share: words, scratch tables in the cluster's shared folder, freeing of finished steps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a run on one machine, as in tests, gets a temporary
    one until it ends; a cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.conf.get("spark.master", None) or spark.sparkContext.master).startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tamarack-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tamarack"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder. It cuts the lineage, and outlives any executor. The write's own shuffles go when it ends.
    What no frame (passing) or dropped() deletes before, as a lazy result may still read it, goes when the application ends."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    frames = _open.get()
    if frames:
        frames[-1].append(out)
    return out


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning, _lock = [0, None], threading.Lock()


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries that end inside have their shuffle files removed as they end, by Spark; the session's own setting returns with the last that is open."""
    with _lock:
        if not _cleaning[0]:
            _cleaning[1] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _cleaning[0] += 1
    try:
        yield
    finally:
        with _lock:
            _cleaning[0] -= 1
            if not _cleaning[0]:
                spark.conf.set(_CLEANUP, _cleaning[1])


#: The frames that are open where this is read: each thread, and each asynchronous task, has its own.
_open: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("tables", default=())


class passing:
    """with passing() as own: the tables that written() makes inside, in the same thread, are deleted when it ends, in whatever way, but for those given to
    own.keep(); these belong to what is around it. What reads them later must be done with the others."""

    def __enter__(self) -> passing:
        self.kept: set[str] = set()
        self.own: list[DataFrame] = []
        self.token = _open.set((*_open.get(), self.own))
        return self

    def keep(self, *tables: DataFrame) -> None:
        self.kept |= {t.scratch_path for t in tables}

    def __exit__(self, *_) -> None:
        _open.reset(self.token)
        dropped(*[t for t in self.own if t.scratch_path not in self.kept])
        for outer in _open.get()[-1:]:
            outer.extend(t for t in self.own if t.scratch_path in self.kept)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables of written() that no later step reads."""
    for df in tables:
        path = df is not None and df.__dict__.get("scratch_path")
        if path:
            fs, at = _hadoop(df.sparkSession, path)
            fs.delete(at, True)
            fs.cancelDeleteOnExit(at)


def row_mark(docs: DataFrame, within: str = "") -> Column:
    """A hash of a row's values, nulls told apart; of a struct of them with `within`. Values of map type, which have none, are left out."""
    own = [F.col(f"{within}.`{f.name}`" if within else f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*own, *[c.isNull() for c in own]).alias("mark")


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))
