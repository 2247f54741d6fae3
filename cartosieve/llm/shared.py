"""What the operators share: reading tables and writing intermediate tables where every executor sees them."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from cartosieve.functions.storage import own_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset (tests), one of our own. On a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        spark.sparkContext.setCheckpointDir(own_folder(spark))
        root = spark.sparkContext.getCheckpointDir()
    return root


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """df, written once to the shared folder and read again: its lineage ends there, so a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def power_of_two_at_least(n: int) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, n))))


def slices(texts: list[str | None], rows: int = 512, chars: int = 1 << 22) -> Iterator[list[str | None]]:
    """The texts in their order, so many at once and, but for a single text, so many characters."""
    begin = held = 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if i > begin and (i - begin == rows or held + size > chars):
            yield texts[begin:i]
            begin, held = i, 0
        held += size
    if begin < len(texts):
        yield texts[begin:]


@contextmanager
def batches_of(spark: SparkSession, rows: int, megabytes: int = 8) -> Iterator[None]:
    """While jobs run within, Arrow batches to Python hold at most so many rows and bytes; afterwards the session's own limits hold again."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": f"{megabytes}m"}
    before = {key: spark.conf.get(key) for key in limits}
    try:
        for key, value in limits.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
