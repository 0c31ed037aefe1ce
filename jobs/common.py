"""What the jobs share: settings from a file, the session of a command line, counts for the log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from dataclasses import fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def settings(kind: type, path: str | None):
    """The settings of a job from a JSON file; names that it doesn't know are an error."""
    given = json.loads(Path(path).read_text()) if path else {}
    unknown = set(given) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**given)


def command_line(name: str, text: str, kind: type, paths: dict[str, str], run: Callable) -> None:
    """Parses path arguments and the settings file, runs the job in a session of its own and stops it."""
    p = argparse.ArgumentParser(prog=name, description=text)
    for path, what in paths.items():
        p.add_argument(f"--{path}", required=True, help=what)
    p.add_argument("--config", default=str(Path(__file__).with_name(f"{name}.json")), help="JSON file of settings")
    args = vars(p.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    chosen = settings(kind, args.pop("config"))
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, **args, settings=chosen)
    finally:
        spark.stop()


def table_at(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A written table with the types it was written with."""
    return spark.read.schema(schema).parquet(path)
