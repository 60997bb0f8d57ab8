"""Runs of rows with equal keys in sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def key_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Each run of rows that agree in the first `keys` columns (whole numbers, not null, sorted)."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [np.asarray(batch.column(k)) for k in range(keys)]
        fresh = np.zeros(n, dtype=bool)
        for c in columns:
            fresh[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(fresh).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != held_key:
                yield joined(held)
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
            if b < n:
                yield joined(held)
                held = []
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], names=schema.names)
