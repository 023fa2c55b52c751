"""Runs of equal keys in a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) for each run of rows that agree in the first `keys` columns; a run may span batches. Only one run
    is held at a time, besides the batch it ends in."""
    held: list[pa.RecordBatch] = []
    held_key: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for i in range(keys):
            c = batch.column(i).to_numpy(zero_copy_only=False)
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        for a, b in zip([0, *starts.tolist()], [*starts.tolist(), n], strict=True):
            key = tuple(batch.column(i)[a].as_py() for i in range(keys))
            if held and key != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield held_key, pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """A list column whose lists have one length, as rows of a matrix."""
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])])
    return flat.astype(dtype).reshape(len(column), -1)
