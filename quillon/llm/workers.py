"""Housekeeping in Python workers, which live on from stage to stage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch of whole texts; Spark's own defaults are 10,000 rows and 64 MB.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to a few MB, as an executor has one in several copies for each task.

    A smaller setting of the user's stays.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark.conf.get(size, "67108864b") in ("67108864b", "64MB", "-1b"):
        spark.conf.set(size, f"{BATCH_BYTES}b")


def release() -> None:
    """Give freed memory back to the system, where the allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a GNU C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function from batches to batches, with a :func:`release` at its end."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return wrapped
