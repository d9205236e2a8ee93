"""Experiment configuration: a closed schema with defaults, rules across fields, and fingerprints."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

METRICS = ("roc_auc", "balanced_accuracy", "accuracy", "macro_f1", "brier", "log_loss")
METHODS = ("logvar_lda", "csp_lda", "riemann_lr", "eegnet")
NEEDED = object()

#: Sections, keys, kinds and defaults. They must equal the published ones, or fingerprints would differ.
#: A kind ending in ? allows null.
SCHEMA: dict[str, dict[str, tuple[str, Any]]] = {
    "experiment": {
        "name": ("text", NEEDED), "seed": ("int", NEEDED), "output_root": ("text", "results"), "processed_root": ("text", "data/processed"),
        "cache_root": ("text", "data/moabb-cache"), "continue_on_error": ("flag", False),
    },
    "preprocessing": {
        "fmin": ("number", 8.0), "fmax": ("number", 30.0), "tmin": ("number", 0.5), "tmax": ("number", 3.5), "resample": ("number", 128.0),
        "channels": ("texts?", None), "dtype": ("text", "float32"),
    },
    "split": {
        "policy": ("text", "latest_session_only"), "test_fraction": ("number", 0.3), "repeats": ("int", 10), "allow_trial_level_fallback": ("flag", False),
        "minimum_test_per_class": ("int", 10), "minimum_calibration_per_class": ("int", 40),
    },
    "calibration": {"budgets_per_class": ("ints", [0, 5, 10, 20, 40]), "insufficient_budget": ("text", "error"), "nested": ("flag", True)},
    "source": {"max_subjects": ("int?", None), "max_trials_per_class_per_subject": ("int?", None), "balance_classes_within_subject": ("flag", True)},
    "metrics": {"primary": ("text", "roc_auc"), "secondary": ("texts", ["balanced_accuracy", "accuracy", "macro_f1", "brier", "log_loss"])},
    "classical": {
        "csp_components": ("int", 8), "csp_reg": ("any", "ledoit_wolf"), "logistic_c": ("number", 1.0), "tangent_mean_max_iter": ("int", 50),
        "tangent_mean_tol": ("number", 1e-9),
    },
    "analysis": {
        "bootstrap_resamples": ("int", 2000), "ci_level": ("number", 0.95), "pairwise_budgets": ("ints", [5, 10]), "aucc_max_budget_per_class": ("int", 40),
        "roc_auc_threshold": ("number", 0.75), "balanced_accuracy_threshold": ("number", 0.7), "fit_mixed_effects": ("flag", True),
    },
    "runtime": {"n_jobs_data": ("int", 1), "overwrite_processed": ("flag", False), "resume": ("flag", True), "save_predictions": ("flag", True)},
    "alignment": {"mode": ("text", "none"), "epsilon": ("number", 1e-12)},
    "draws": {"stream": ("text", "hash")},
}
DATASET = {"name": ("text", NEEDED), "subjects": ("subjects", "all"), "exclude_subjects": ("ints", [])}
PROCESSING_VERSION = 1


def _whole(v: Any) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


KINDS: dict[str, Callable[[Any], bool]] = {
    "text": lambda v: isinstance(v, str),
    "int": _whole,
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "flag": lambda v: isinstance(v, bool),
    "texts": lambda v: isinstance(v, list | tuple) and all(isinstance(x, str) for x in v),
    "ints": lambda v: isinstance(v, list | tuple) and all(_whole(x) for x in v),
    "subjects": lambda v: v == "all" or (isinstance(v, list | tuple) and all(_whole(x) for x in v)),
    "any": lambda v: True,
}


def _section(given: Any, schema: dict, where: str) -> dict:
    if not isinstance(given, dict):
        raise TypeError(f"{where}: a mapping is expected")
    if extra := sorted(set(given) - set(schema)):
        raise ValueError(f"{where}: unknown keys {extra}")
    out = {}
    for key, (kind, default) in schema.items():
        value = given.get(key, default)
        if value is NEEDED:
            raise ValueError(f"{where}.{key} is missing")
        if value is not None or not kind.endswith("?"):
            kind = kind.rstrip("?")
            if not KINDS[kind](value):
                raise TypeError(f"{where}.{key}: {kind} expected")
            value = float(value) if kind == "number" else list(value) if isinstance(value, list | tuple) else value
        out[key] = value
    return out


def _unique(v: list) -> bool:
    return len(v) == len(set(v))


def _positive_or_null(v: int | None) -> bool:
    return v is None or v > 0


#: Each rule across fields, and what it says when broken.
RULES: list[tuple[str, Callable[[dict], bool]]] = [
    ("the experiment has a name", lambda c: bool(c["experiment"]["name"].strip())),
    ("the seed is not negative", lambda c: c["experiment"]["seed"] >= 0),
    ("0 < fmin < fmax", lambda c: 0 < c["preprocessing"]["fmin"] < c["preprocessing"]["fmax"]),
    ("tmin < tmax", lambda c: c["preprocessing"]["tmin"] < c["preprocessing"]["tmax"]),
    ("the rate exceeds twice fmax", lambda c: c["preprocessing"]["resample"] > 2 * c["preprocessing"]["fmax"]),
    ("dtype is float32 or float64", lambda c: c["preprocessing"]["dtype"] in ("float32", "float64")),
    ("channels are null, or some and unique", lambda c: (v := c["preprocessing"]["channels"]) is None or bool(v) and _unique(v)),
    ("the split policy is known", lambda c: c["split"]["policy"] in ("latest_session_only", "latest_session_then_latest_runs", "latest_runs_only")),
    ("0 < test_fraction < 1", lambda c: 0 < c["split"]["test_fraction"] < 1),
    ("repeats and minima are positive", lambda c: min(c["split"][k] for k in ("repeats", "minimum_test_per_class", "minimum_calibration_per_class")) > 0),
    ("budgets begin with zero and increase", lambda c: (b := c["calibration"]["budgets_per_class"])[:1] == [0] and sorted(set(b)) == b),
    ("a short budget is skipped or an error", lambda c: c["calibration"]["insufficient_budget"] in ("skip", "error")),
    ("samples are nested", lambda c: c["calibration"]["nested"]),
    ("the pool covers the largest budget", lambda c: c["split"]["minimum_calibration_per_class"] >= max(c["calibration"]["budgets_per_class"])),
    ("source caps are positive or null", lambda c: _positive_or_null(c["source"]["max_subjects"]) and _positive_or_null(c["source"]["max_trials_per_class_per_subject"])),
    ("there are datasets, of unique names", lambda c: bool(c["datasets"]) and _unique([d["name"] for d in c["datasets"]]) and all(d["name"].strip() for d in c["datasets"])),
    ("subjects are all, or some, unique and positive", lambda c: all(d["subjects"] == "all" or d["subjects"] and _unique(d["subjects"]) and min(d["subjects"]) > 0 for d in c["datasets"])),
    ("excluded subjects are positive and not listed", lambda c: all(min(d["exclude_subjects"], default=1) > 0 and (d["subjects"] == "all" or not set(d["subjects"]) & set(d["exclude_subjects"])) for d in c["datasets"])),
    ("methods are known, some and unique", lambda c: bool(c["methods"]) and set(c["methods"]) <= set(METHODS) and _unique(c["methods"])),
    ("metrics are known and unique", lambda c: set(m := [c["metrics"]["primary"], *c["metrics"]["secondary"]]) <= set(METRICS) and _unique(m)),
    ("classical settings are positive", lambda c: min(c["classical"][k] for k in ("csp_components", "logistic_c", "tangent_mean_max_iter", "tangent_mean_tol")) > 0),
    ("at least 100 resamples", lambda c: c["analysis"]["bootstrap_resamples"] >= 100),
    ("0 < ci_level < 1", lambda c: 0 < c["analysis"]["ci_level"] < 1),
    ("pairwise budgets are positive, unique and configured", lambda c: _unique(b := c["analysis"]["pairwise_budgets"]) and set(b) <= set(c["calibration"]["budgets_per_class"]) - {0}),
    ("the horizon is a positive budget", lambda c: c["analysis"]["aucc_max_budget_per_class"] in c["calibration"]["budgets_per_class"][1:]),
    ("thresholds lie in [0, 1]", lambda c: all(0 <= c["analysis"][k] <= 1 for k in ("roc_auc_threshold", "balanced_accuracy_threshold"))),
    ("there is a data job", lambda c: c["runtime"]["n_jobs_data"] >= 1),
    ("the alignment mode is known and its floor positive", lambda c: c["alignment"]["mode"] in ("none", "euclidean_training_only") and c["alignment"]["epsilon"] > 0),
    ("draws come from hashes or from NumPy's streams", lambda c: c["draws"]["stream"] in ("hash", "numpy")),
]


def fingerprint(value: Any, length: int = 16) -> str:
    """The head of the SHA-256 of compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:length]


class Config:
    """A configuration with all defaults filled in. TypeError or ValueError for one outside the schema or against a rule."""

    def __init__(self, given: dict):
        if not isinstance(given, dict):
            raise TypeError("a configuration is a mapping")
        if extra := sorted(set(given) - set(SCHEMA) - {"datasets", "methods"}):
            raise ValueError(f"unknown sections {extra}")
        if missing := [s for s in ("experiment", "preprocessing", "datasets") if s not in given]:
            raise ValueError(f"missing sections {missing}")
        c = {s: _section(given.get(s, {}), schema, s) for s, schema in SCHEMA.items()}
        if not isinstance(given["datasets"], list | tuple):
            raise TypeError("datasets: a list is expected")
        c["datasets"] = [_section(d, DATASET, f"datasets[{k}]") for k, d in enumerate(given["datasets"])]
        methods = given.get("methods", ["logvar_lda", "csp_lda", "riemann_lr"])
        if not KINDS["texts"](methods):
            raise TypeError("methods: texts expected")
        c["methods"] = list(methods)
        for said, holds in RULES:
            if not holds(c):
                raise ValueError(f"broken rule: {said}")
        self.values = c

    def __getitem__(self, section: str) -> Any:
        return self.values[section]

    @property
    def preprocessing_fingerprint(self) -> str:
        return fingerprint({"processing_schema_version": PROCESSING_VERSION} | self["preprocessing"])

    @property
    def experiment_fingerprint(self) -> str:
        """Of everything; of an alignment only if there is one, and of draws only if they are not the usual ones."""
        usual = {"alignment": lambda v: v["mode"] == "none", "draws": lambda v: v["stream"] == "hash"}
        return fingerprint({k: v for k, v in self.values.items() if k not in usual or not usual[k](v)})

    @property
    def output_dir(self) -> str:
        return f"{self['experiment']['output_root']}/{self['experiment']['name']}-{self.experiment_fingerprint}"

    @property
    def processed_dir(self) -> str:
        return f"{self['experiment']['processed_root']}/{self.preprocessing_fingerprint}"


def load(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return Config(yaml.safe_load(f))
