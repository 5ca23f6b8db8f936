"""Runs of equal keys in a task's sorted batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterable[pa.RecordBatch], name: str) -> Iterator[tuple[int, pa.Table]]:
    """(key, rows) of each run of the integer column ``name``, by which the batches are sorted."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(name))
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            if held and keys[a] != key:
                yield int(key), pa.Table.from_batches(held)
                held = []
            key = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield int(key), pa.Table.from_batches(held)


def whole(rows: pa.Table, name: str) -> pa.Array:
    """A column in one piece, without the rows around a slice."""
    c = rows.column(name).combine_chunks()
    return pa.concat_arrays(c.chunks if isinstance(c, pa.ChunkedArray) else [c])
