"""Row checks over streams: they keep no state, so they run as they are on each batch of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from cartosieve.functions.storage import shared_folder
from cartosieve.plans import issues


def issue_stream(features: DataFrame, check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stream of features to a stream of issues."""
    return issues.finished(check(features))


def run_available(stream: DataFrame, tag: str) -> DataFrame:
    """Runs the stream over all that is there, writing issues once, and reads them back."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, tag)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
