"""Cutting a plan's lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that ``spark.checkpoint.dir`` names.

    A local session without that setting (a unit test) gets a temporary folder of its own; a cluster
    without it is an error, since executors share no local folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint-"))
    return df.checkpoint()


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or a new temporary one if all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix=prefix)
