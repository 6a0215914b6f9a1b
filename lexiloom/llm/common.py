"""Shared folder, lineage cuts and small column helpers for the pipeline operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of an Arrow batch at most; a row over it is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where the session names none (single-machine tests) a temporary folder is used; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="lexiloom-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared folder and cuts its lineage; shuffle files that only it needed can go."""
    shared_dir(df.sparkSession)
    held = df.checkpoint(eager=True)
    del df  # it holds the plan that has run, and so its shuffle files
    release(held.sparkSession)
    return held


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back; shuffle files that only it needed can go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexiloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of frames that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sorted_merge(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that never goes to the driver: a small shuffle grows behind its size check (rows are exploded, tables hashed), and broadcasts stay in the driver's memory."""
    return df.hint("merge")


def give_back() -> None:
    """Returns a Python worker's free memory to the system; the worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches bounded in rows and bytes (a setting of the session), which bounds a worker's memory."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        df.sparkSession.conf.set(f"spark.sql.execution.arrow.{key}", str(most))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def word_count(column: Column) -> Column:
    """Number of WORD runs of a text; null has none."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Slices batches so that a slice holds about ``limit`` bytes of ``column`` at most (one row at least)."""
    import numpy as np

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        values = batch.column(column)
        wide = values.type in (pa.large_string(), pa.large_binary())
        offsets = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + n + 1].astype(np.int64)
        at = 0
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), n, at + rows)
            yield batch.slice(at, end - at)
            at = end
