"""Small helpers for operators that read texts as Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Recent(dict):
    """A bounded memo of a pure function: two generations of at most `size` keys, so frequent keys stay.

    A key that is in neither is computed once. Only speed depends on what it holds.
    """

    def __init__(self, compute: Callable, size: int = 400_000):
        super().__init__()
        self.compute, self.size, self.older = compute, size, {}

    def __missing__(self, key):
        value = self.older.get(key, self)
        if value is self:
            value = self.compute(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that a task holds few texts as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def slices_of_bytes(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `size` bytes of a string column, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy().astype(np.int64))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
