"""Arrow batches in pieces whose size in bytes is bounded, whatever the length of their texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, column: str | int, most: int, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most `rows` rows with about `most` bytes of `column` each; a longer value has a run to itself or ends one."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), dtype=np.int64)
    run = (np.cumsum(sizes) - sizes) // most
    cut = np.flatnonzero(np.diff(run)) + 1
    for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
        for at in range(a, b, rows or max(1, b - a)):
            yield batch.slice(at, min(rows or b, b - at))


def each_row(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows as Python values, one at a time, so that large values are not all held twice."""
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in batch.columns)


def give_back() -> None:
    """Hand freed memory back to the system. A Python worker goes on to other tasks, and would hold what its largest one took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library of Linux
    if trim:
        trim(0)


def frugal(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, which goes through a task's batches, and gives back its memory at the end."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run
