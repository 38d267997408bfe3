"""Intermediate tables that several branches of a run read."""
from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; all executors share it.

    Where the option is unset, a session on one machine (``local[n]``) gets a temporary folder. On a cluster
    that is an error: each executor would write to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="relinker-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Writes a result once to the checkpoint folder and cuts its lineage, so the rows outlive any executor."""
    session = df.sparkSession
    folder = shared_folder(session)
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
