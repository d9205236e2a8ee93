"""Where results come from: the package's own content, requirements and what is installed of them, run manifests."""

from __future__ import annotations

import hashlib
import importlib.metadata
import importlib.resources
import os
import platform
import re
import subprocess
import sys
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import NamedTuple

from pyspark.sql import SparkSession

from tamarack.config import Config
from tamarack.sources import files

MANIFEST = "run_manifest.json"


class Requirement(NamedTuple):
    """A package with the versions that do (least included, below excluded), and the method that needs it; empty: every run does."""

    package: str
    least: str
    below: str
    method: str = ""


REQUIREMENTS = (
    Requirement("pyspark", "4.1", "5"), Requirement("pyarrow", "15", "99"), Requirement("numpy", "2.0", "3"), Requirement("pandas", "2.2", "4"),
    Requirement("duckdb", "1.0", "2", "oracle"), Requirement("torch", "2.0", "3", "eegnet"),
)


def package_versions() -> dict[str, str | None]:
    """What is installed of the requirements; null for what is not."""
    installed = {(d.metadata["Name"] or "").lower(): d.version for d in importlib.metadata.distributions()}
    return {r.package: installed.get(r.package) for r in REQUIREMENTS}


def _release(version: str) -> tuple[int, ...]:
    return tuple(int(x) for x in re.findall(r"\d+", version.split("+")[0])[:3])


def unmet(methods: list[str] = ()) -> list[str]:
    """What these methods need and is missing, or installed in a version outside its bounds."""
    have, said = package_versions(), []
    for r in REQUIREMENTS:
        if r.method and r.method not in methods:
            continue
        v = have[r.package]
        if v is None:
            said.append(f"{r.package} is missing, which {r.method or 'every run'} needs")
        elif not _release(r.least) <= _release(v) < _release(r.below):
            said.append(f"{r.package} {v} is installed, versions from {r.least} to below {r.below} do")
    return said


def _modules(at, prefix: str = "") -> Iterator[tuple[str, bytes]]:
    for x in at.iterdir():
        if x.is_dir() and not x.name.startswith((".", "__pycache__")):
            yield from _modules(x, f"{prefix}{x.name}.")
        elif x.name.endswith(".py"):
            yield prefix + x.name.removesuffix(".py"), x.read_bytes()


def package_digest(package: str = "tamarack") -> str:
    """One SHA-256 of an importable package's modules, by name, wherever they are loaded from."""
    whole = hashlib.sha256()
    for name, content in sorted(_modules(importlib.resources.files(package))):
        whole.update(f"{name} {len(content)}\n".encode() + content)
    return whole.hexdigest()


def revision(root: str = ".") -> str | None:
    """The revision that root is a checkout of, with -dirty behind it if files differ; null for none."""
    asked = subprocess.run(["git", "-C", root, "describe", "--always", "--abbrev=40", "--exclude=*", "--dirty"], capture_output=True, text=True, check=False) if os.path.isdir(root) else None
    return asked.stdout.strip() or None if asked and not asked.returncode else None


def run_manifest(config: Config, root: str = ".") -> dict:
    """The manifest's keys are a stored format."""
    at, name = revision(root), platform.uname()
    return {
        "schema_version": 1, "experiment_name": config["experiment"]["name"], "experiment_fingerprint": config.experiment_fingerprint,
        "preprocessing_fingerprint": config.preprocessing_fingerprint, "started_utc": datetime.now(UTC).isoformat(), "python": sys.version,
        "platform": platform.platform(), "machine": name.machine, "processor": name.processor, "package_versions": package_versions(),
        "git": {"commit": at and at.removesuffix("-dirty"), "dirty": at and at.endswith("-dirty")}, "repository_source_sha256": package_digest(), "configuration": config.values,
    }


def started(spark: SparkSession, config: Config, root: str = ".", **more) -> dict:
    """The run's manifest, written when the run starts. A run that goes on must agree with it: fingerprints, packages, the package's content, and what else is
    given; else it raises."""
    path, now = f"{config.output_dir}/{MANIFEST}", run_manifest(config, root) | more
    if not files.exists(spark, path):
        files.write_json(spark, path, now)
        return now
    was = files.read_json(spark, path)
    held = ("experiment_fingerprint", "preprocessing_fingerprint", "package_versions", "repository_source_sha256", *more)
    if unlike := [k for k in held if was.get(k) != now[k]]:
        raise ValueError(f"{path} was written by an unlike run: {unlike}")
    return was


def outputs(spark: SparkSession, folder: str, names: list[str], **more) -> dict:
    """A manifest of a step's outputs with their checksums."""
    return {"schema_version": 1, "created_utc": datetime.now(UTC).isoformat(), **more, "outputs": {n: files.digest(spark, f"{folder}/{n}") for n in names}}


def environment(config: Config | None = None, synthetic_only: bool = False) -> dict:
    """Can the configuration run here? status, errors (unmet requirements, datasets without a source) and warnings (folders to be made)."""
    errors, warnings = unmet(config["methods"] if config else []), []
    if config and not synthetic_only:
        from tamarack.sources.archive import ADAPTERS

        local = lambda d: os.path.isdir(os.path.join(config["experiment"]["cache_root"], d))
        errors += [f"dataset {d['name']} has neither an adapter nor recordings in cache_root" for d in config["datasets"] if d["name"] not in (*ADAPTERS, "SyntheticMI") and not local(d["name"])]
    roots = {k: v for k, v in config["experiment"].items() if k.endswith("_root") and "://" not in v} if config else {}
    warnings += [f"{k}: nothing is there to make {v} in" for k, v in sorted(roots.items()) if not os.path.isdir(os.path.dirname(os.path.abspath(v)))]
    report = {"status": "failed" if errors else "ok", "errors": errors, "warnings": warnings, "public_data_stack_required": not synthetic_only}
    return report | {"package_versions": package_versions(), "python": sys.version, "platform": platform.platform(), "repository_source_sha256": package_digest()}
