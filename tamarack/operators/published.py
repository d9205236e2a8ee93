"""The four assignment tables of a run from NumPy's published random streams, chosen by draws.stream: numpy, so that a seed assigns what it assigned elsewhere.

Draws of a subject depend on its own trials, of a pair on the source's: Spark groups these, and each group's draws are few lines of NumPy (bootstrap.py). Splits by sessions
and runs are not drawn. A split by single trials would need another library's stream, and raises.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.config import fingerprint
from tamarack.operators import assign, bootstrap, reuse

#: The keys of what a split's id is a digest of.
SPLIT = "dataset string, target_subject string, repeat int, split_strategy string, split_id string, trial_uid string, session string, run string, group_id string, label int, role string"
SAMPLE = "dataset string, target_subject string, repeat int, split_id string, budget_per_class int, trial_uid string, session string, run string, group_id string, label int, selected_at_budget int"
PAIR = "dataset string, target_subject string, source_subject string, selection_seed long"
TAKEN = f"{PAIR}, trial_uid string, session string, run string, label int"


def named(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


def details(d: pd.DataFrame, strategy: str, fraction: float) -> dict:
    """What a split's digest says of how it was made. d: a subject's trials in chronological order, with role."""
    test = d["role"] == "test"
    if strategy == "latest_session":
        sessions = [str(s) for s in d["session"].drop_duplicates()]
        return {"test_session": sessions[-1], "calibration_sessions": sessions[:-1], "chronological": True}
    groups = [f"{s}::{r}" for s, r in d.loc[test, ["session", "run"]].drop_duplicates().itertuples(index=False)]
    return {"test_fraction_requested": float(fraction), "test_fraction_observed": float(test.sum() / len(d)), "test_groups": groups, "suffix_group_count": len(groups), "chronological": True}


def tables(t: DataFrame, seed: int, split: dict, calibration: dict, source: dict) -> dict[str, DataFrame]:
    """As assign.tables, from the published streams."""
    t = t.join(reuse.positions(t), ["dataset", "subject", "trial_uid"]).select("dataset", "subject", "session", "run", "trial_uid", "label", "position")
    if split["allow_trial_level_fallback"]:
        raise ValueError("splits by single trials have no published stream here")
    own = assign.target_split(t, split["test_fraction"], split["minimum_test_per_class"], split["minimum_calibration_per_class"], seed, False, split["policy"])
    both = "dataset string, subject string, kind int, repeat int, split_strategy string, split_id string, budget_per_class int, trial_uid string, session string, run string, group_id string, label int, role string, selected_at_budget int"

    def assigned(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("position").reset_index(drop=True)
        strategy = d["strategy"].iloc[0]
        if strategy is None:
            raise ValueError(f"no valid split of {key}")
        test = (d["role"] == "test").to_numpy()
        uids = d["trial_uid"].to_numpy()
        name = assign.STRATEGIES[strategy]
        digest = {"strategy": name, "calibration_trial_uids": sorted(uids[~test]), "test_trial_uids": sorted(uids[test]), "details": details(d, strategy, split["test_fraction"])}
        split_id, rows = fingerprint(digest, 20), []
        about = [(u, str(s), str(r), f"{s}::{r}", int(x)) for u, s, r, x in d[["trial_uid", "session", "run", "label"]].itertuples(index=False)]
        for repeat in range(split["repeats"]):
            rows += [(*key, 0, repeat, name, split_id, None, *about[k], "test" if test[k] else "calibration_pool", None) for k in range(len(d))]
            got = bootstrap.nested(d["label"].to_numpy(), np.flatnonzero(~test), calibration["budgets_per_class"], bootstrap.seed_of(seed, *key, repeat, "calibration"), calibration["insufficient_budget"])
            first: dict[int, int] = {}
            for b in sorted(got):
                for k in got[b]:
                    rows.append((*key, 1, repeat, name, split_id, b, *about[k], None, first.setdefault(int(k), b)))
        return pd.DataFrame(rows, columns=named(both)).astype({"budget_per_class": "Int32", "selected_at_budget": "Int32"})

    rows = own.groupBy("dataset", "subject").applyInPandas(assigned, both).withColumnRenamed("subject", "target_subject")
    subjects = t.select("dataset", "subject").distinct()
    others = subjects.groupBy("dataset").agg(F.array_sort(F.collect_list("subject")).alias("all"))  # participants of a dataset: a permutation of them is drawn for each target

    def chosen(batches):
        for b in batches:
            out = []
            for d, target, known in b.itertuples(index=False):
                for s in bootstrap.source_subjects(list(known), target, source["max_subjects"], bootstrap.seed_of(seed, d, target, "source_subjects")):
                    out.append((d, target, s, bootstrap.seed_of(seed, d, target, s, "source_trials")))
            yield pd.DataFrame(out, columns=named(PAIR))

    pairs = subjects.join(others, "dataset").select("dataset", "subject", "all").mapInPandas(chosen, PAIR)

    def taken(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("position").reset_index(drop=True)
        at = bootstrap.source_trials(d["label"].to_numpy(), source["max_trials_per_class_per_subject"], source["balance_classes_within_subject"], int(d["selection_seed"].iloc[0]))
        return d.iloc[at][named(TAKEN)].astype({"session": str, "run": str})

    of = t.withColumnRenamed("subject", "source_subject")
    detail = pairs.join(of, ["dataset", "source_subject"]).groupBy("dataset", "target_subject", "source_subject").applyInPandas(taken, TAKEN)

    def said(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        ones = int(d["label"].sum())
        return pd.DataFrame([(*key, int(d["selection_seed"].iloc[0]), len(d), len(d) - ones, ones, fingerprint(sorted(d["trial_uid"]), 64))], columns=named(SELECTION))

    selection = detail.groupBy("dataset", "target_subject", "source_subject").applyInPandas(said, SELECTION)
    return {"split_assignments": rows.filter("kind = 0").select(*named(SPLIT)), "calibration_assignments": rows.filter("kind = 1").select(*named(SAMPLE)), "source_selection": selection, "source_trial_assignments": detail}


SELECTION = f"{PAIR}, selected_trials int, class_0_trials int, class_1_trials int, selected_trial_uid_sha256 string"
