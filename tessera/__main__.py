"""python -m tessera COMMAND PATH: a configuration file for the first three, an experiment's folder for the others."""

from __future__ import annotations

import argparse
import json

COMMANDS = ("validate", "inspect", "run", "resume", "status", "consensus", "interpret", "report", "bundle")


def main() -> None:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("path")
    a = p.parse_args()
    from pyspark.sql import SparkSession

    from tessera.plans.experiment import Experiment

    spark = SparkSession.builder.getOrCreate()
    e = Experiment.from_yaml(spark, a.path) if a.command in ("validate", "inspect", "run") else Experiment.from_output_dir(spark, a.path)
    act = {"validate": e.validate, "inspect": e.inspect_data, "run": e.run, "resume": e.resume, "status": e.status, "consensus": e.build_consensus, "interpret": e.run_interpretation, "report": e.report, "bundle": e.export_manuscript_bundle}[a.command]
    got = act()
    if hasattr(got, "show"):
        got.show(50, truncate=False)
    else:
        print(json.dumps(got, indent=2, default=str))


if __name__ == "__main__":
    main()
