"""The shared folder for intermediate tables.

A cluster names it in ``spark.checkpoint.dir``.  Only a local session without that setting
gets a folder of its own; on a cluster a missing setting is an error, because a
machine-local folder would be lost with its machine.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; made up only for a local session that has none."""
    context = spark.sparkContext
    folder = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir", None)
        or context.getCheckpointDir()
    )
    if folder is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="psephos-")
        context.setCheckpointDir(folder)
    return folder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder for a table written on the way."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from a table in the shared folder.

    Later steps neither rescan its input nor depend on the executors that computed it, and
    read only the columns they use.  Retention is up to whoever owns the folder.
    """
    path = scratch_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
