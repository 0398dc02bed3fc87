"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import sys
import types
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwatch.session import shared_path

#: Rows are taken from an Arrow batch in slices of about so many text bytes, so
#: that a batch of very long texts is never held as Python objects all at once.
SLICE_BYTES = 8 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The table survives lost executors and cuts the lineage; it lies below the
    folder in ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    path = shared_path(spark, "llm", name, fresh=True)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker (models, lookup tables)."""
    return sys.modules.setdefault("_gridwatch_llm_worker", types.ModuleType("_gridwatch_llm_worker")).__dict__


def release() -> None:
    """Give memory that is freed, but kept by the allocators, back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(run):
    """``run`` for mapInArrow, releasing memory at its end: the Python worker lives on into later tasks and stages."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()
    return wrapped


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024):
    """Arrow batches of so many rows for the jobs run inside the block: whole texts are held outside the heap, batch by batch, on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES):
    """Zero-copy slices of a batch with about ``limit`` bytes of text each (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    if batch.nbytes <= limit:
        yield batch
        return
    column = batch.column(batch.schema.get_field_index(text))
    lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i in range(n):
        if i > start and size + lengths[i] > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += int(lengths[i])
    yield batch.slice(start, n - start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def bucket_of_id(id_column, buckets: int):
    """crc32 of the id written as text, modulo ``buckets`` (null for a null id)."""
    return F.crc32(id_column.cast("string").cast("binary")) % F.lit(buckets)


def text_expr(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


import pyarrow.compute  # noqa: E402,F401  (pa.compute above)
