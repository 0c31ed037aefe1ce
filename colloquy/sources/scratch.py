"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    A session on one machine that names none gets a temporary one; on a cluster that is an
    error, as other machines could not see it.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="colloquy-"))
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """The same rows from a written table: lineage ends here, and a lost executor repeats nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, for functions that run in Python there."""
    sc = spark.sparkContext
    if not getattr(sc, "_colloquy_shipped", False):
        package = Path(__file__).resolve().parents[1]
        to = tempfile.mkdtemp(prefix="colloquy-")
        sc.addPyFile(shutil.make_archive(f"{to}/{package.name}", "zip", package.parent, package.name))
        sc._colloquy_shipped = True
