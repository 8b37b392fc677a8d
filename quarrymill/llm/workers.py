"""How Python workers go through their input."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa

#: Rows that a worker holds as Python objects at a time.
ROWS = 1000


def trim() -> None:
    """Gives the system back what Arrow's pool and the C library hold unused: workers live on after their task, beside others of the executor."""
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows; trims after each slice."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
            trim()
