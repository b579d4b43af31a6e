"""What tasks in Python workers share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: What a task hands its worker at once, in bytes. Of Spark's own 64 MB an executor keeps much, in pieces that nothing later fits.
BATCH_BYTES = 4 << 20


def in_workers(rows: DataFrame, work: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``rows`` worked through by ``work`` in small batches; a row larger than that is a batch by itself.

    The size is a setting of the session. It stays, since the rows may be read later.
    """
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows.mapInArrow(released(work), schema)


def released(work: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work`` on the batches of a task; then the worker, which waits for its next task, gives free memory back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run
