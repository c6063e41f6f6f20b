"""Helpers of this subpackage: intermediate tables in the shared folder, and row-slicing for Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"  # whole texts are large rows
HEAP = 0.5
_forget: dict[str, Callable[[], None]] = {}


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/coilwise-llm/{label}-{uuid.uuid4().hex}"


def _tidy(spark: SparkSession) -> None:
    """Let the driver give back what the queries before have left, once its heap has grown to HEAP of its limit.

    Operators of many short queries would otherwise grow the heap to its limit, far above what lives in it. What
    counts is the heap that the JVM holds, which young collections empty but do not give back.
    """
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP * heap.maxMemory():
        spark._jvm.System.gc()
        pa.default_memory_pool().release_unused()


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it again: lineage ends there and its shuffle files go.

    Parquet with zstd is a fraction of a checkpoint's size. The caller drops the folder once nothing
    lazy reads it any more.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, label)
    _tidy(spark)
    with _setting(spark, CLEANUP, "true"), _setting(spark, BATCH, "1000"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def in_buckets(rows: DataFrame, column: str, label: str) -> DataFrame:
    """Write rows where they are, in buckets of a column, to the shared folder: a join by it moves the other side alone."""
    spark, name = rows.sparkSession, f"coilwise_{label}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, column).option("compression", "zstd").option("path", new_folder(spark, label)).saveAsTable(name)
    return spark.table(name)


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove stored tables that are no longer read."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        place = hadoop(p)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def row_key() -> Column:
    """Identity of a row of documents: doc_id, null last in order, and a digest of its text."""
    digest = F.coalesce(F.unhex(F.md5(F.col("text").cast("binary"))), F.lit(bytearray()))
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), digest.alias("digest"))


def keeps(name: str, forget: Callable[[], None]) -> None:
    """Name a cache of this worker, which the tasks of other operators will have emptied."""
    _forget[name] = forget


def _make_room(keep: str | None) -> None:
    """Empty the caches of other operators and give freed memory back; workers live longer than their tasks."""
    for name in [n for n in _forget if n != keep]:
        _forget.pop(name)()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 512 << 10, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds about ``most`` bytes of text, or one long row.

    Caches of the worker but ``keep`` are emptied first.
    """
    _make_room(keep)
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield b.slice(first, i - first)
                first, held = i, 0
            held += int(n)
        yield b.slice(first)
