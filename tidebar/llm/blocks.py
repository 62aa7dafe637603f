"""Groups of rows that reach a task in order, as whole Arrow tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that come ordered by ``keys``, in tables that hold whole groups: many small ones or one large one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [np.asarray(batch.column(k)) for k in keys]
        if held:
            last = [held[-1].column(k)[-1].as_py() for k in keys]
            other = np.flatnonzero(np.logical_or.reduce([c != x for c, x in zip(own, last, strict=True)]))
            if not len(other):
                held.append(batch)
                continue
            if other[0]:
                held.append(batch.slice(0, other[0]))
            yield pa.Table.from_batches(held)
            held, batch = [], batch.slice(other[0])
            own = [c[other[0] :] for c in own]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in own]))
        if len(change):
            yield pa.Table.from_batches([batch.slice(0, change[-1] + 1)])
            batch = batch.slice(change[-1] + 1)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def bounds(*columns: np.ndarray) -> np.ndarray:
    """Where groups of equal neighbours start, and the end."""
    change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
    return np.concatenate(([0], change, [len(columns[0])]))
