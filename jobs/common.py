"""What the jobs share: config files, the command line's session, paths, and counts of what was written."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def settings(defaults: dict, given: dict) -> dict:
    """``defaults`` with what is given in their stead; ValueError for an unknown name, a missing one, or one of another kind."""
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown settings: {unknown}")
    out = defaults | given
    if missing := sorted(k for k, v in out.items() if v is None):
        raise ValueError(f"missing settings: {missing}")
    for k, v in defaults.items():
        kinds = (int, float) if isinstance(v, float) else type(v)
        if v is not None and not isinstance(out[k], kinds):
            raise ValueError(f"{k} is {out[k]!r}; a {type(v).__name__} is needed")
    return out


def below(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows, and their number once they have been written: no further pass over them. For use right before a write."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def command_line(name: str, about: str, defaults: dict, run) -> None:
    """Run a job with the settings of a file, those of the command line in their stead; makes and stops the session."""
    parser = argparse.ArgumentParser(prog=name, description=about)
    parser.add_argument("--config", default=os.path.join(ROOT, "jobs", f"{name}.json"), help="JSON file of settings")
    for k, v in defaults.items():
        parser.add_argument(f"--{k.replace('_', '-')}", default=None, type=json.loads if isinstance(v, (list, int, float)) else str)
    said = vars(parser.parse_args())
    with open(said.pop("config"), encoding="utf-8") as f:
        config = json.load(f) | {k: v for k, v in said.items() if v is not None}
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(f"tessera-{name}").getOrCreate()
    try:
        from tessera.session import ship

        ship(spark, ROOT)
        run(spark, config)
    finally:
        spark.stop()
