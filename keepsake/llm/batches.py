"""Python over Arrow batches of bounded size, in workers that give their memory back."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_ROWS = 1000
SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def release() -> None:
    """Returns freed memory to the system: a worker stays alive for later tasks and shares its executor's memory with them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`df.mapInArrow(run, schema)` with batches of at most BATCH_ROWS rows, a setting of the session that stays."""
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(SETTING)) <= BATCH_ROWS:
        spark.conf.set(SETTING, str(BATCH_ROWS))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(bounded, schema)
