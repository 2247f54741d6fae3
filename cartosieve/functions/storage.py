"""Where lineage is cut: the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def own_folder(spark: SparkSession) -> str:
    """A new folder of this machine, where no shared one is named; only in local mode, as executors elsewhere would not see it."""
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors see")
    return tempfile.mkdtemp(prefix="spark-shared-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder. Where no folder is named (tests), one of our own is."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or own_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder where every executor sees it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or own_folder(spark)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
