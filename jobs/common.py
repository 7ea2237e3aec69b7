"""What the jobs share: settings from a small JSON file, the command line, logs and counts."""

from __future__ import annotations

import argparse
import json
import logging
import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

log = logging.getLogger("ionflow.jobs")


def settings(path: str | None, defaults: dict) -> dict:
    """defaults with those of the file over them; unknown names are errors."""
    own = {}
    if path:
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
    if unknown := set(own) - set(defaults):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return defaults | own


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], int]]:
    """df, whose rows are counted while a write runs, and a function that then gives their number."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), lambda: seen.get["rows"]


def stream_path(path: str) -> str:
    """A glob that nothing but path matches: a file stream takes a single file, unlike a folder, by a glob alone."""
    path = re.sub(r"([\\{}\[\]*?])", r"\\\1", path.rstrip("/"))
    return re.sub(r"([0-9A-Za-z])(?=[^0-9A-Za-z]*$)", r"[\1]", path, count=1)


def main(name: str, paths: list[str], defaults: dict, run: Callable, argv: list[str] | None = None) -> int:
    """Command line of a job: a path each, --config; it creates the session and stops it."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config", default=os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json"))
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    own = settings(args.config, defaults)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, *(getattr(args, p) for p in paths), own)
    finally:
        spark.stop()
    return 0
