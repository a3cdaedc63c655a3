"""Folders for written tables that all executors share, and the side of a join that grows with the input."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is set a temporary one serves a local session only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, so that it is computed once and lost executors cost a reread.

    The table stays there; whoever owns the folder empties it after the job.
    """
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that deals out both sides by key, whatever their files' sizes.

    Spark plans joins by the bytes of files, and files of numbered codes and names take a hundredth of what their rows take in
    memory: left to itself it would gather millions of rows in the driver to broadcast them.
    """
    return df.hint("merge")
