"""Seeded synthetic trials: coloured noise and a rhythm that one side of the channels shows more in either class."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Spec:
    dataset: str = "SyntheticMI"
    subjects: int = 3
    sessions: int = 2
    runs: int = 1
    per_class: int = 6
    channels: int = 3
    samples: int = 128
    rate: float = 128.0
    rhythm: float = 10.0
    seed: int = 20260811

    def __post_init__(self):
        if min(self.subjects, self.sessions, self.runs, self.per_class, self.channels, self.samples) < 1 or self.channels < 2 or self.seed < 0:
            raise ValueError("counts are positive, channels two or more, the seed not negative")
        if not 0 < self.rhythm < self.rate / 2:
            raise ValueError("the rhythm lies below half the rate")


COLUMNS = "dataset string, subject string, session int, run int, trial_index int, trial_uid string, label int, x array<array<double>>"


def coloured(rng: np.random.Generator, shape: tuple[int, ...], keep: float = 0.72) -> np.ndarray:
    """Noise of which each sample keeps a share of the one before."""
    noise = rng.standard_normal(shape)
    for k in range(1, shape[-1]):
        noise[..., k] += keep * noise[..., k - 1]
    return noise


def subject_rows(spec: Spec, s: int) -> list[tuple]:
    """A subject's trials; they depend on the seed and its number only."""
    rng = np.random.default_rng([spec.seed, s])
    time, rows = np.arange(spec.samples) / spec.rate, []
    for session in range(spec.sessions):
        for run in range(spec.runs):
            for k, label in enumerate(rng.permutation([0, 1] * spec.per_class)):
                gain = np.full(spec.channels, 0.4)
                gain[0 if label == 0 else -1] = 1.6
                wave = np.sin(2 * np.pi * spec.rhythm * time + rng.uniform(0, 2 * np.pi))
                x = 0.5 * coloured(rng, (spec.channels, spec.samples)) + gain[:, None] * wave
                rows.append((spec.dataset, str(s + 1), session, run, k, f"{spec.dataset}:{s + 1}:{session}:{run}:{k:05d}", int(label), x.tolist()))
    return rows


def trials(spark: SparkSession, spec: Spec = Spec()) -> DataFrame:
    """One task a subject."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b["id"].astype(int):
                yield pd.DataFrame(subject_rows(spec, s), columns=[c.split()[0] for c in COLUMNS.split(", ")])

    return spark.range(0, spec.subjects, 1, spec.subjects).mapInPandas(make, COLUMNS)
