"""Tables and files between jobs: they lie in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
#: Bytes of an Arrow batch, but for one row that is longer.
BATCH_BYTES = "2m"
#: Bytes of text that a worker of the retrieval half turns into rows at a time.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Where that setting is missing, a folder of this machine
    serves a session whose tasks all run on it; on a cluster the setting is required."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        if not _LOCAL:
            _LOCAL.append(f"file://{tempfile.mkdtemp(prefix='gleaner-')}")
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/gleaner-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe when executors are lost. The shuffle files of its
    job go when it is written, as nothing reads them again, not when the driver happens to collect its garbage."""
    path, conf, name = shared_dir(df.sparkSession, label), df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of a session by bytes, unless it has a bound: 10,000 texts a batch, Spark's own bound, stand in the
    executor and in the worker several times at once, and what they take is kept. It holds where a table is planned, so the setting stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows of the batches, in slices of at most ``most`` bytes of a text column, or of one row that is longer: what a worker makes of
    a slice stands in memory at once, whatever the size of the batches."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def spread(df: DataFrame) -> DataFrame:
    """``df``, for work that takes much longer than reading: rows of an input so small that Spark reads it in fewer tasks
    than there are cores (one row group is one task) are dealt out to all of them. Any larger input is left as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * (4 << 20) else df
