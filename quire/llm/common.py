"""Shared storage, staging and Arrow helpers of the pipeline operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised operator handles at once; a longer single text is handled alone.
BLOCK_BYTES = 1 << 20
#: Bounds of one Arrow batch: rows, and bytes (a batch ends with the row that passes them).
ARROW_ROWS, ARROW_BYTES = 1000, 32 << 20

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, local sessions (tests) get a temporary one; a cluster gets an error, as its executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        key = spark.sparkContext.applicationId
        if key not in _fallback:
            _fallback[key] = f"file://{tempfile.mkdtemp(prefix='quire-')}"
        found = _fallback[key]
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/quire/{what}-{uuid.uuid4().hex}"


def stage(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage is cut, lost executors cost nothing."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """Session settings for the plans made and run within."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: A Bloom filter of bounded size over the smaller side's keys keeps most rows without a partner out of a join's shuffle.
BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
}


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a staged folder through Hadoop's file system of that path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Spark's own values of the batch settings; others were chosen by a user and are kept.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", ARROW_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", ARROW_BYTES)}


def arrow_session(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes, as rows are whole texts. Spark reads these settings when a plan runs, after the operator that made it has returned, so they stay in the session."""
    for key, (default, value) in _BATCH.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, str(value))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    held = {c.lower() for c in df.columns}
    return next(name for k in range(len(held) + 1) if (name := f"{stem}_{k}") not in held)


def integral(df: DataFrame, *columns: str) -> None:
    """Raises a ValueError unless these columns are integers: ids are compared and ordered as longs."""
    for c in columns:
        if df.schema[c].dataType.typeName() not in ("byte", "short", "integer", "long"):
            raise ValueError(f"column {c} must hold integers, not {df.schema[c].dataType.simpleString()}")


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out evenly when the input has fewer partitions than the session's parallelism."""
    spark = df.sparkSession
    least = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)


def lower_ascii(col):
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes; a longer row is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def list_array(values: np.ndarray, counts: Iterable[int], kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
