"""Participant bootstraps and samples from NumPy's published random streams, so that a seed gives the same draws anywhere.

Hash-ordered draws (assign, curves) are what the engine uses by default; these serve comparisons with results of such streams.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many numbers are drawn at once; a stream goes on where it stopped, so blocks change nothing.
AT_ONCE = 1 << 22


def seed_of(seed: int, *parts) -> int:
    """The first four bytes of the SHA-256 of a JSON list of the seed and the parts as strings."""
    text = json.dumps([int(seed), *map(str, parts)], separators=(",", ":"), ensure_ascii=False)
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "big")


def interval(values: np.ndarray, resamples: int, level: float, seed: int) -> tuple[float | None, float | None, float | None, int]:
    """Mean, lower and upper percentile limit of the means of resamples, and how many finite values there are. One value is its own interval."""
    v = np.asarray(values, float)
    v = v[np.isfinite(v)]
    if len(v) < 2:
        one = float(v[0]) if len(v) else None
        return one, one, one, len(v)
    rng, means = np.random.default_rng(seed), []
    for k in range(0, resamples, step := max(1, AT_ONCE // len(v))):
        means.append(v[rng.integers(0, len(v), (min(step, resamples - k), len(v)))].mean(axis=1))
    tail = (1 - level) / 2
    low, high = np.quantile(np.concatenate(means), [tail, 1 - tail])
    return float(v.mean()), float(low), float(high), len(v)


def intervals(df: DataFrame, keys: list[str], value: str, resamples: int, level: float, seed: Callable[[tuple], int], order: tuple[str, ...] = ("dataset", "target_subject")) -> DataFrame:
    """keys, estimate, ci_lower, ci_upper, n_values. Values are participants', which are few; they are drawn from in order of their ids as text. seed: of a group's keys."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", estimate double, ci_lower double, ci_upper double, n_values int"

    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(names, kind="stable")
        return pd.DataFrame([(*key, *interval(d["value_"].to_numpy(), resamples, level, seed(key)))], columns=[c.split()[0] for c in schema.split(", ")])

    names = [f"{c}_order_" for c in order]
    own = df.select(*keys, *[F.col(c).cast("string").alias(n) for c, n in zip(order, names, strict=True)], F.col(value).cast("double").alias("value_"))
    return own.groupBy(*keys).applyInPandas(run, schema)


def paired_seed(seed: int, metric: str, kind: str = "paired-regime") -> Callable[[tuple], int]:
    """Seeds of groups whose keys are (scope, method, budget) or, of areas, (scope, regime)."""
    return lambda key: seed_of(seed, kind, *key, metric)


def curve_seed(seed: int) -> Callable[[tuple], int]:
    """Seeds of groups whose keys are (dataset, method, regime, budget, metric)."""
    return lambda key: seed_of(seed, "curve", *key)


def nested(labels: np.ndarray, pool: np.ndarray, budgets: list[int], seed: int, short: str = "error") -> dict[int, np.ndarray]:
    """Positions by budget, in the order of presentation: each class's pool is shuffled, 0 then 1, from one stream; a budget takes the first of each.
    A budget that a class can't fill raises, or with 'skip' is left out. Budget 0 takes none."""
    labels, pool = np.asarray(labels, int), np.asarray(pool, int)
    if len(np.unique(pool)) != len(pool):
        raise ValueError("the pool has a trial twice")
    rng, order = np.random.default_rng(seed), []
    for k in (0, 1):
        own = pool[labels[pool] == k].copy()
        rng.shuffle(own)
        order.append(own)
    out = {}
    for b in budgets:
        if min(map(len, order)) < b:
            if short == "error":
                raise ValueError(f"the pool has too few trials for budget {b}")
            continue
        taken = np.concatenate([o[:b] for o in order])
        if b:
            np.random.default_rng(seed + b).shuffle(taken)
        out[b] = taken
    return out


def source_subjects(subjects: list[str], target: str, most: int | None, seed: int) -> list[str]:
    """The target's sources: all other subjects, sorted as text, or `most` of them drawn without replacement."""
    others = sorted(str(s) for s in subjects if str(s) != str(target))
    if not others:
        raise ValueError("there is no other subject")
    if most is None or most >= len(others):
        return others
    return sorted(np.random.default_rng(seed).choice(np.array(others, object), most, replace=False).tolist())


def source_trials(labels: np.ndarray, cap: int | None, balance: bool, seed: int) -> np.ndarray:
    """Positions of a source's trials in shuffled order: as many of either class as the smaller has, or all, up to the cap."""
    labels, rng = np.asarray(labels, int), np.random.default_rng(seed)
    of = [np.flatnonzero(labels == k) for k in (0, 1)]
    if not min(map(len, of)):
        raise ValueError("a source needs both classes")
    most = min(map(len, of)) if balance else max(map(len, of))
    most = most if cap is None else min(most, cap)
    taken = []
    for own in of:
        rng.shuffle(own)
        taken.append(own[:most])
    out = np.concatenate(taken)
    rng.shuffle(out)
    return out


def nested_samples(t: DataFrame, budgets: list[int], seed: int, repeat: int = 0, short: str = "error") -> DataFrame:
    """dataset, subject, budget, trial_uid, label, place (of presentation), selected_at_budget of a pool t (dataset, subject, trial_uid, label, position): a subject's
    trials, which its task holds, drawn by the seed derived from seed, dataset, subject and repeat."""
    schema = "dataset string, subject string, budget int, trial_uid string, label int, place int, selected_at_budget int"

    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("position", kind="stable").reset_index(drop=True)
        got = nested(d["label"].to_numpy(), np.arange(len(d)), budgets, seed_of(seed, key[0], key[1], repeat, "calibration"), short)
        first: dict[int, int] = {}
        for b in sorted(got):
            for k in got[b]:
                first.setdefault(int(k), b)
        rows = [(*key, b, d["trial_uid"][k], int(d["label"][k]), n, first[int(k)]) for b in sorted(got) for n, k in enumerate(got[b])]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return t.select("dataset", "subject", "trial_uid", "label", "position").groupBy("dataset", "subject").applyInPandas(run, schema)
