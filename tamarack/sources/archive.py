"""A data source of trials: spark.read.format("trials").option("adapter", name).load(), one partition for each subject.

An adapter makes a subject's trials where its partition is read, so that a public archive is fetched and filtered on the executors.
The synthetic adapter is built in; others are registered by name. No archive is reachable without a network, so none comes along. A dataset
without an adapter may lie as recordings in a folder of its name (see recordings.py).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tamarack.sources import files, recordings, synthetic

#: name -> (subjects of the options, trials of a subject and the options as rows of synthetic.COLUMNS)
ADAPTERS: dict[str, tuple[Callable[[dict], list[str]], Callable[[str, dict], Iterator[tuple]]]] = {}


def adapter(name: str):
    """Registers a function of (subject, options); its attribute `subjects` lists them. A second one of a name raises."""

    def add(make: Callable[[str, dict], Iterator[tuple]]):
        if name in ADAPTERS:
            raise ValueError(f"adapter {name} is registered already")
        ADAPTERS[name] = (make.subjects, make)
        return make

    return add


def _spec(options: dict) -> synthetic.Spec:
    number = {k: type(v)(options[k]) for k, v in vars(synthetic.Spec()).items() if k in options}
    return synthetic.Spec(**number)


def _synthetic(subject: str, options: dict) -> Iterator[tuple]:
    yield from synthetic.subject_rows(_spec(options), int(subject) - 1)


_synthetic.subjects = lambda options: [str(k + 1) for k in range(_spec(options).subjects)]
adapter("synthetic")(_synthetic)


class Subject(InputPartition):
    def __init__(self, subject: str):
        self.subject = subject


class TrialReader(DataSourceReader):
    def __init__(self, options: dict, found: tuple):
        self.options, (self.listed, self.make) = options, found

    def partitions(self) -> list[InputPartition]:
        wanted = self.options.get("only")
        return [Subject(s) for s in self.listed(self.options) if not wanted or s in wanted.split(",")]

    def read(self, partition: Subject) -> Iterator[tuple]:
        yield from self.make(partition.subject, self.options)


class TrialSource(DataSource):
    """Options: adapter, only (comma-joined subjects; all by default), and what the adapter takes."""

    @classmethod
    def name(cls) -> str:
        return "trials"

    def schema(self) -> str:
        return synthetic.COLUMNS

    def reader(self, schema) -> DataSourceReader:
        name = self.options.get("adapter", "synthetic")
        if name not in ADAPTERS:
            raise ValueError(f"no adapter {name}; there are {sorted(ADAPTERS)}")
        return TrialReader(dict(self.options), ADAPTERS[name])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TrialSource)


#: The events of the two classes.
EVENTS = {"left_hand": 0, "right_hand": 1}


def available(spark: SparkSession, dataset: str, folder: str, options: dict) -> list[str]:
    """The subjects of a dataset: of its adapter, or of the recordings in the folder."""
    name = "synthetic" if dataset == "SyntheticMI" else dataset
    if name in ADAPTERS:
        return ADAPTERS[name][0](options)
    if not files.exists(spark, folder):
        raise ValueError(f"no adapter is registered for dataset {dataset}, and {folder} has no recordings")
    return [r.subject for r in recordings.listed(spark, folder).select("subject").distinct().collect()]  # a row for each subject


def trials(spark: SparkSession, dataset: str, folder: str, options: dict, preprocessing: dict, subjects: list[str]) -> DataFrame:
    """The trials of these subjects, by the dataset's adapter or from its recordings."""
    name = "synthetic" if dataset == "SyntheticMI" else dataset
    if name in ADAPTERS:
        return spark.read.format("trials").option("adapter", name).options(**options, only=",".join(subjects)).load()
    p = preprocessing
    cut = recordings.Cut(p["fmin"], p["fmax"], p["tmin"], p["tmax"], p["resample"], EVENTS, p["channels"])
    made = recordings.trials(spark, dataset, folder, cut, subjects)
    return made.withColumn("x", made.x.cast("array<array<float>>").cast("array<array<double>>")) if p["dtype"] == "float32" else made
