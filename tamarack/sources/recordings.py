"""Continuous recordings in the European Data Format (EDF, EDF+C): a data source of blocks split by byte ranges, and trials cut out of the filtered signal.

A file has a header of 256 bytes and 256 for each signal, then data records of equal size: for each signal its samples of that record, as
16-bit integers. Events are annotations. Files are named as the Brain Imaging Data Structure does: sub-<subject>[_ses-<session>]...[_run-<run>]...edf, in any folders.

Trials: blocks are read where they are needed and never shuffled. A first pass gives each block's end state, when begun with zero, and its events; what blocks really begin with follows
from these small rows. A second pass does the same for the way back. The third filters each block both ways and cuts what its events' windows have of
it; pieces of a window that lies over two blocks or more meet by trial, and are resampled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tamarack.operators import signal

#: The header's fields and their bytes, and a signal's. Volts for each unit.
HEADER = (("version", 8), ("patient", 80), ("recording", 80), ("date", 8), ("time", 8), ("bytes", 8), ("kind", 44), ("records", 8), ("seconds", 8), ("signals", 4))
SIGNAL = (("label", 16), ("transducer", 80), ("unit", 8), ("low", 8), ("high", 8), ("least", 8), ("most", 8), ("prefilter", 80), ("samples", 8), ("reserved", 32))
ANNOTATIONS = "EDF Annotations"
VOLTS = {"V": 1.0, "mV": 1e-3, "uV": 1e-6, "µV": 1e-6, "nV": 1e-9}
NAME = re.compile(r"sub-([^_/]+)(?:_ses-([^_/]+))?(?:_[^/]*?)?(?:_run-([^_/]+))?(?:_[^/]*)?\.edf$")
#: Seconds of a block, at least.
BLOCK = 60.0


@dataclass(frozen=True)
class Header:
    start: int
    records: int
    seconds: float
    labels: tuple[str, ...]
    samples: tuple[int, ...]
    scale: tuple[float, ...]
    offset: tuple[float, ...]

    @property
    def width(self) -> int:
        return 2 * sum(self.samples)

    def chosen(self, channels: list[str] | None) -> list[int]:
        """The signals of the channels, in their order; all but annotations by default. One rate for all."""
        known = [x for x in self.labels if x != ANNOTATIONS]
        if missing := [c for c in channels or [] if c not in known]:
            raise ValueError(f"channels are not recorded: {missing}")
        out = [self.labels.index(c) for c in channels or known]
        if len({self.samples[k] for k in out}) != 1:
            raise ValueError("the channels' rates differ, or there are none")
        return out

    def rate(self, chosen: list[int]) -> float:
        return self.samples[chosen[0]] / self.seconds


def opened(path: str) -> tuple:
    """A file that pyarrow reads: local, or of any store that it knows by the address."""
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(at), system.get_file_info(at).size


def header(f, size: int) -> Header:
    def fields(raw: bytes, names: tuple, n: int = 1) -> dict[str, list[str]]:
        out, at = {}, 0
        for name, width in names:
            out[name] = [raw[at + k * width : at + (k + 1) * width].decode("latin-1").strip() for k in range(n)]
            at += n * width
        return out

    h = {k: v[0] for k, v in fields(f.read_at(256, 0), HEADER).items()}
    n, start = int(h["signals"]), int(h["bytes"])
    if h["kind"].startswith("EDF+D"):
        raise ValueError("discontinuous recordings are not read")
    s = fields(f.read_at(start - 256, 256), SIGNAL, n)
    samples = tuple(int(x) for x in s["samples"])
    records = int(h["records"])
    whole = (size - start) // (2 * sum(samples))
    if records > whole:
        raise ValueError(f"{records} records are promised, the file holds {whole}")
    low, high, least, most = ([float(x) for x in s[k]] for k in ("low", "high", "least", "most"))
    per = [(b - a) / (d - c) for a, b, c, d in zip(low, high, least, most, strict=True)]
    volts = [VOLTS.get(u, 1.0) for u in s["unit"]]
    return Header(
        start, whole if records < 0 else records, float(h["seconds"]), tuple(s["label"]), samples,
        tuple(p * v for p, v in zip(per, volts, strict=True)), tuple((a - p * c) * v for a, p, c, v in zip(low, per, least, volts, strict=True)),
    )


def cuts(h: Header, seconds: float) -> list[tuple[int, int]]:
    """first record and number of records of each block; what is left over goes to the last."""
    per = max(1, round(seconds / h.seconds)) if h.seconds else 1
    n = max(1, h.records // per)
    return [(k * per, per if k < n - 1 else h.records - k * per) for k in range(n)] if h.records else []


def block(f, h: Header, first: int, n: int, chosen: list[int]) -> tuple[np.ndarray, list[tuple[float, str]]]:
    """Channels of samples in volts, and the events (seconds from the file's start, text), of n records."""
    raw = np.frombuffer(f.read_at(n * h.width, h.start + first * h.width), "<i2").reshape(n, -1)
    at = np.concatenate([[0], np.cumsum(h.samples)])
    x = np.array([raw[:, at[k] : at[k + 1]].ravel() * h.scale[k] + h.offset[k] for k in chosen])
    events = []
    for k, label in enumerate(h.labels):
        if label == ANNOTATIONS:
            for record in np.ascontiguousarray(raw[:, at[k] : at[k + 1]]):
                for entry in record.tobytes().split(b"\x00"):
                    onset, *texts = entry.split(b"\x14")
                    if texts and onset:
                        events += [(float(onset.split(b"\x15")[0]), t.decode()) for t in texts if t]
    return x, events


class Range(InputPartition):
    def __init__(self, path: str, number: int, first: int, n: int):
        self.path, self.number, self.first, self.n = path, number, first, n


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.seconds = options["path"].split(","), float(options.get("seconds", BLOCK))
        self.channels = options["channels"].split(",") if options.get("channels") else None

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
            info = system.get_file_info(at)
            found = [at] if info.is_file else sorted(x.path for x in system.get_file_info(fs.FileSelector(at, recursive=True)) if x.path.endswith(".edf"))
            for one in found:
                with system.open_input_file(one) as f:
                    h = header(f, system.get_file_info(one).size)
                out += [Range(path.removesuffix(at) + one, k, *c) for k, c in enumerate(cuts(h, self.seconds))]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        f, size = opened(partition.path)
        with f:
            h = header(f, size)
            chosen = h.chosen(self.channels)
            x, events = block(f, h, partition.first, partition.n, chosen)
        yield partition.path, partition.number, partition.first * h.samples[chosen[0]], h.rate(chosen), [h.labels[k] for k in chosen], x.tolist(), events


class RecordingSource(DataSource):
    """spark.read.format("recordings").option("path", files or folders, comma-joined): a row for each block, a partition for each byte range. Options: seconds of a
    block, channels (comma-joined)."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return "path string, block int, start long, rate double, channels array<string>, x array<array<double>>, events array<struct<onset:double,text:string>>"

    def reader(self, schema) -> DataSourceReader:
        return BlockReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordingSource)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path, subject, session, run of the recordings below path. Sessions and runs are numbers; one that lacks is 0."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.edf").load(path).select("path")  # no content is read
    part = lambda k: F.regexp_extract("path", NAME.pattern, k)
    number = lambda k: F.when(part(k) == "", 0).otherwise(part(k).cast("int"))
    return found.filter(F.col("path").rlike(NAME.pattern)).select("path", part(1).alias("subject"), number(2).alias("session"), number(3).alias("run"))


@dataclass(frozen=True)
class Cut:
    """What is cut out of recordings: band, window in seconds about an event (both ends included), rate, events by text, channels."""

    fmin: float
    fmax: float
    tmin: float
    tmax: float
    resample: float
    labels: dict[str, int]
    channels: list[str] | None = None
    seconds: float = BLOCK
    order: int = 4

    def window(self, onset: float, rate: float) -> tuple[int, int]:
        """The samples of an event, end excluded."""
        first = round(onset * rate) + round(self.tmin * rate)
        return first, first + round((self.tmax - self.tmin) * rate) + 1


def _blocks(found: DataFrame, cut: Cut) -> DataFrame:
    """A row for each block: path, block, first, n, last (is it the recording's last)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                f, size = opened(path)
                with f:
                    own = cuts(header(f, size), cut.seconds)
                yield pd.DataFrame([(path, k, *c, k == len(own) - 1) for k, c in enumerate(own)], columns=["path", "block", "first", "n", "last"])

    made = found.repartition("path").mapInPandas(run, "path string, block int, first long, n long, last boolean")
    return made.repartition("path", "block")  # blocks of one recording go to many tasks


def _states(rows: pd.DataFrame, column: str, size: int) -> np.ndarray:
    return np.array([np.frombuffer(x) for x in rows[column]]).reshape(len(rows), -1, size)


def _passes(way: str, cut: Cut):
    """The function of a pass over blocks. ahead: end states, first samples and events. back: end states of the way back. pieces: what windows have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                f, size = opened(r.path)
                with f:
                    h = header(f, size)
                    chosen = h.chosen(cut.channels)
                    x, events = block(f, h, r.first, r.n, chosen)
                rate = h.rate(chosen)
                s = signal.system(cut.fmin, cut.fmax, rate, cut.order)
                start, n, zero = r.first * h.samples[chosen[0]], x.shape[1], np.zeros((len(x), len(s.a)))
                long = signal.extended(x, s.edge, r.block == 0, r.last)
                if way == "ahead":
                    wanted = [(*cut.window(o, rate), o, cut.labels[t]) for o, t in events if t in cut.labels]
                    rows.append((r.path, r.block, start, n, long.shape[1], rate, s.run(long, zero)[1].tobytes(), long[:, 0].tobytes(), wanted))
                    continue
                y, _ = s.run(long, np.frombuffer(r.begin).reshape(zero.shape))
                if way == "back":
                    rows.append((r.path, r.block, s.run(y[:, ::-1], zero)[1].tobytes(), y[:, -1].tobytes()))
                    continue
                z = s.run(y[:, ::-1], np.frombuffer(r.returns).reshape(zero.shape))[0][:, ::-1]
                z = z[:, s.edge if r.block == 0 else 0 :][:, :n]
                for e in r.events:
                    a, b_ = max(e["a"], start), min(e["b"], start + n)
                    rows.append((r.path, e["nth"], e["label"], rate, int(a), z[:, a - start : b_ - start].tolist()))
            yield pd.DataFrame(rows, columns=names)

    schema = {
        "ahead": "path string, block int, start long, samples long, extended long, rate double, end binary, edge binary, events array<struct<a:long,b:long,onset:double,label:int>>",
        "back": "path string, block int, end binary, edge binary",
        "pieces": "path string, nth int, label int, rate double, at long, x array<array<double>>",
    }[way]
    names = [c.split()[0] for c in re.split(r", (?![a-z]+:)", schema)]
    return run, schema


def _begun(ends: DataFrame, cut: Cut, back: bool) -> DataFrame:
    """path, block and the state that each block begins with (on the way back: returns with), from a row for each block. A recording's rows meet: a few numbers each."""
    name = "returns" if back else "begin"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", ascending=not back)
        s = signal.system(cut.fmin, cut.fmax, float(rows["rate"].iloc[0]), cut.order)
        first = np.outer(np.frombuffer(rows["edge"].iloc[0]), s.rest)
        got = s.begun(rows["extended"].to_numpy(), _states(rows, "end", len(s.a)), first)
        return pd.DataFrame({"path": rows["path"], "block": rows["block"], name: [x.tobytes() for x in got]})

    return ends.groupBy("path").applyInPandas(run, f"path string, block int, {name} binary")


def trials(spark: SparkSession, dataset: str, path: str, cut: Cut, subjects: list[str] | None = None) -> DataFrame:
    """dataset, subject, session, run, trial_index, trial_uid, label, x: the windows about the events whose texts cut.labels has, filtered and resampled, of the recordings below path.

    Trials of a subject are numbered by session, run and onset. Windows that a recording does not hold whole are left out. A recording without such events gives none."""
    found = listed(spark, path).cache()
    if subjects is not None:
        found = found.filter(F.col("subject").isin(subjects))
    blocks = _blocks(found.select("path"), cut).cache()
    ahead = blocks.mapInPandas(*_passes("ahead", cut)).cache()  # a few hundred bytes a block and channel
    size = ahead.groupBy("path").agg(F.sum("samples").alias("all"))
    begin = blocks.join(_begun(ahead, cut, False), ["path", "block"])
    back = begin.mapInPandas(*_passes("back", cut)).join(ahead.select("path", "block", "extended", "rate"), ["path", "block"])
    line = Window.partitionBy("subject").orderBy("session", "run", "onset", "label")  # over events, not signals
    events = ahead.select("path", F.inline("events")).join(size, "path").filter("a >= 0 and b <= `all`").drop("all").distinct().join(found, "path").withColumn("nth", F.row_number().over(line) - 1)
    of = events.join(ahead.select("path", "block", "start", "samples"), "path").filter("a < start + samples and b > start")
    of = of.groupBy("path", "block").agg(F.collect_list(F.struct("a", "b", "nth", "label")).alias("events"))  # a block's own
    pieces = begin.join(_begun(back, cut, True), ["path", "block"]).join(of, ["path", "block"]).mapInPandas(*_passes("pieces", cut))
    whole = pieces.groupBy("path", "nth", "label", "rate").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("pieces"))  # a window's own

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [np.concatenate([np.array([np.asarray(c) for c in p["x"]]) for p in ps], 1) for ps in b["pieces"]]
            out = [signal.resampled(v, r, cut.resample).tolist() for v, r in zip(x, b["rate"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "trial_index": b["nth"], "label": b["label"], "x": out})

    made = whole.mapInPandas(joined, "path string, trial_index int, label int, x array<array<double>>").join(found, "path")
    uid = F.concat_ws(":", F.lit(dataset), "subject", "session", "run", F.lpad(F.col("trial_index").cast("string"), 5, "0"))
    return made.select(F.lit(dataset).alias("dataset"), "subject", "session", "run", "trial_index", uid.alias("trial_uid"), "label", "x")
