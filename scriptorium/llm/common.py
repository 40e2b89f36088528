"""What the operators share: scratch tables in the cluster's shared folder, bounds of batches and of samples."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, SparkSession

from scriptorium.storage import discard, exists, saved, scratch_path, shared_dir, table

#: Rows in an Arrow batch sent to Python; texts can be long, so fewer than Spark's 10,000.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of texts; a smaller setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def low_hash(h: Column, wanted: int, total: int) -> Column:
    """Whether a 64-bit hash is so low that about `wanted` of `total` different ones are, and with some room to spare.

    An ORDER BY with LIMIT brings the limit's rows of every partition to the driver; after this filter it brings few.
    """
    share = (wanted + 6 * wanted**0.5 + 50) / max(1, total)
    return h <= (2**63 - 1 if share >= 1 else int(share * 2**64) - 2**63)


def release(spark: SparkSession) -> None:
    """Frees what earlier work left on the driver: plans, broadcasts and shuffles that nothing refers to any more.

    Spark's cleaner drops them when the driver's JVM collects garbage, which a large heap puts off.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()


def returned() -> None:
    """Gives a Python worker's freed memory back to the system: workers outlive their task, and what they keep adds up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has its own ways
        ctypes.CDLL(None).malloc_trim(0)


__all__ = ["ARROW_ROWS", "discard", "exists", "low_hash", "release", "returned", "saved", "scratch_path", "shared_dir", "small_batches", "table"]
