"""Walking Arrow batches in pieces of bounded size, whatever the length of single texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text handled at once in a Python worker; one longer text makes a piece of its own.
PIECE = 4 << 20


#: Rows of texts that go to a Python worker at once, in the jobs that small_batches() holds for.
ROWS = 2000
_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """For the jobs inside: batches of at most ROWS rows, since both sides hold a batch or two of each task."""
    before = spark.conf.get(_ROWS_CONF)
    if 0 < int(before) <= ROWS:
        yield
        return
    spark.conf.set(_ROWS_CONF, str(ROWS))
    try:
        yield
    finally:
        spark.conf.set(_ROWS_CONF, before)


def give_back() -> None:
    """Returns to the system what this process has freed; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which its worker holds no freed memory: idle workers stay for a minute, beside the jobs that follow."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def pieces(batches: Iterator[pa.RecordBatch], text_col: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and the offsets of each; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, ends - ends[0]
