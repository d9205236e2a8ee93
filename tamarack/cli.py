"""Command line: python -m tamarack COMMAND. Exit code 0 where all is well, 2 where an audit or the environment is not."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from tamarack import benchmark, provenance
from tamarack.config import load
from tamarack.sources import files

COMMANDS = {
    "prepare": "make and save the trials of the configured datasets", "validate-data": "check saved trials, manifests and checksums", "run": "fit all configured conditions",
    "aggregate": "audit a run and write its summaries and tests", "figures": "write the rows that figures show", "audit": "check all rules of a run's tables", "tables": "write publication tables",
    "robustness": "tests without a dataset, and the model's other form", "compare": "hold an aligned run against the primary one",
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tamarack", description="Leakage-resistant calibration benchmarks on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    of = {}
    for name, text in COMMANDS.items():
        of[name] = sub.add_parser(name, help=text)
        of[name].add_argument("--config", required=True, help="YAML configuration")
    of["validate-data"].add_argument("--skip-checksums", action="store_true", help="do not read the files for their checksums")
    of["run"].add_argument("--repository-root", default=".", help="the repository whose state is recorded")
    of["run"].add_argument("--assignment-source", help="the run whose assignments an aligned run takes up")
    of["robustness"].add_argument("--without", required=True, help="the dataset to leave out")
    of["robustness"].add_argument("--participants", type=int, help="how many participants must be left")
    of["compare"].add_argument("--other", required=True, help="YAML configuration of the aligned run")
    of["compare"].add_argument("--output", required=True, help="the folder to write to")
    environment = sub.add_parser("environment", help="check packages and configuration")
    environment.add_argument("--config")
    environment.add_argument("--repository-root", default=".")
    environment.add_argument("--synthetic-only", action="store_true", help="no public archive is needed")
    smoke = sub.add_parser("smoke", help="run everything over synthetic trials, twice")
    smoke.add_argument("--workspace", default=".smoke-work")
    smoke.add_argument("--no-clean", action="store_true")
    smoke.add_argument("--no-figures", action="store_true")
    return p


def shown(value: dict) -> None:
    print(json.dumps(value, indent=2, sort_keys=True, default=files.plain))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    config = load(args.config) if getattr(args, "config", None) else None
    if args.command == "environment":
        found = provenance.environment(config, args.synthetic_only)
        shown(found)
        return 0 if found["status"] == "ok" else 2
    if args.command == "run" and benchmark.aligned(config) and not args.assignment_source:
        raise SystemExit("--assignment-source is needed where alignment.mode is not none")
    spark = spark or SparkSession.builder.appName(f"tamarack {args.command}").getOrCreate()
    if args.command == "smoke":
        shown(benchmark.smoke(spark, args.workspace, not args.no_clean, not args.no_figures))
    elif args.command == "prepare":
        print(*benchmark.prepare(spark, config), sep="\n")
    elif args.command == "validate-data":
        path = f"{config.processed_dir}/validation-{config.experiment_fingerprint}.csv"
        files.replace_table(benchmark.validate_data(spark, config, not args.skip_checksums), path)
        spark.read.option("header", True).csv(path).show(1000, truncate=False)
        print(f"Saved: {path}")
    elif args.command == "run":
        print(benchmark.run(spark, config, args.repository_root, args.assignment_source))
    elif args.command == "audit":
        found = benchmark.audit(spark, config)
        shown(found)
        return 0 if found["status"] == "ok" else 2
    elif args.command == "robustness":
        print(benchmark.robustness(spark, config, args.without, args.participants))
    elif args.command == "compare":
        print(benchmark.compare(spark, config, load(args.other), args.output))
    else:
        print({"aggregate": benchmark.aggregate, "figures": benchmark.figures, "tables": benchmark.tables}[args.command](spark, config))
    return 0
