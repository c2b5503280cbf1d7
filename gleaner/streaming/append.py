"""Entries as a stream: every micro-batch is appended and is searchable when it has committed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def stream_append(source: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Appends a streaming table to Parquet; all that is there is taken, then the query ends. A batch that is
    repeated after a failure replaces its own folder, so rows are never doubled."""

    def write(batch: DataFrame, number: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")
