"""One CSV file that jobs append to: df.write.format("appended").mode("append").option("path", file).save().

Two phases: each task writes its rows as a file of its own beside the target, a gzip member with gzip; when all tasks are done, the driver's commit puts the old file and the
members, in order of partitions, into one new file that replaces the old one. The first append writes the header. A job that fails leaves the file as it was.
Only compressed bytes pass the commit, in pieces. Nulls are empty, numbers print so that they read back exactly.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv, fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

PIECE = 1 << 24


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def size_of(system: fs.FileSystem, at: str) -> int:
    info = system.get_file_info(at)
    return info.size if info.is_file else 0


def lines(batch: pa.RecordBatch | None, names: list[str]) -> bytes:
    """A batch as lines without a header, or the header for none."""
    out = io.BytesIO()
    table = pa.Table.from_batches([batch]).select(names) if batch is not None else pa.table({n: pa.array([], pa.string()) for n in names})
    csv.write_csv(table, out, csv.WriteOptions(include_header=batch is None, quoting_style="needed"))
    return out.getvalue()


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class AppendWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.zipped = options["path"], options.get("gzip", "true").lower() == "true"
        self.names = options["columns"].split(",") if options.get("columns") else names
        if missing := [n for n in self.names if n not in names]:
            raise ValueError(f"the rows lack the columns {missing}")
        system, at = located(self.path)
        self.staged = f"{at}.{uuid.uuid4().hex}.parts"
        self.before = size_of(system, at)
        if self.before:
            with system.open_input_stream(at, compression="gzip" if self.zipped else None) as f:
                head, want = f.read(1 << 16), lines(None, self.names)
            if not head.startswith(want):
                raise ValueError(f"{self.path} has other columns: {head.splitlines()[0].decode()}")

    def _packed(self, raw: bytes) -> bytes:
        return gzip.compress(raw, 6, mtime=0) if self.zipped else raw

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        """A task's rows; each attempt has a file of its own."""
        system, _ = located(self.path)
        number, rows = TaskContext.get().partitionId(), 0
        system.create_dir(self.staged)
        at = f"{self.staged}/{number:08d}-{uuid.uuid4().hex}"
        with system.open_output_stream(at, compression=None) as f:
            for batch in iterator:
                if batch.num_rows:
                    f.write(self._packed(lines(batch, self.names)))
                    rows += batch.num_rows
        return Part(number, at, rows)

    def commit(self, messages: list[Part]) -> None:
        system, at = located(self.path)
        parts = [m for m in sorted(messages, key=lambda m: m.partition) if m is not None and m.rows]
        if parts:
            whole = f"{self.staged}/whole"
            with system.open_output_stream(whole, compression=None) as out:
                if not self.before:
                    out.write(self._packed(lines(None, self.names)))
                for one in [at] * bool(self.before) + [m.path for m in parts]:
                    with system.open_input_stream(one, compression=None) as f:
                        while piece := f.read(PIECE):
                            out.write(piece)
            if size_of(system, at) != self.before:
                raise RuntimeError(f"another job appended to {self.path} meanwhile")
            system.move(whole, at)
        self._cleared(system)

    def abort(self, messages: list[Part]) -> None:
        self._cleared(located(self.path)[0])

    def _cleared(self, system: fs.FileSystem) -> None:
        if system.get_file_info(self.staged).type == fs.FileType.Directory:
            system.delete_dir(self.staged)


class AppendSource(DataSource):
    """Options: path, gzip (true), columns (comma-joined; all by default, in their order)."""

    @classmethod
    def name(cls) -> str:
        return "appended"

    def writer(self, schema, overwrite: bool) -> AppendWriter:
        if overwrite:
            raise ValueError("this sink appends")
        return AppendWriter(dict(self.options), schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AppendSource)


def append(df: DataFrame, path: str, columns: list[str] | None = None, zipped: bool = True) -> None:
    """Appends df's rows to the file at path, in the order of its partitions."""
    register(df.sparkSession)
    writer = df.write.format("appended").mode("append").option("path", path).option("gzip", str(zipped).lower())
    (writer.option("columns", ",".join(columns)) if columns else writer).save()
