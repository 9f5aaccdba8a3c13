"""Counters of a fixed number, summed over tasks.

Each task keeps one table and emits its parts that aren't zero once, at its end; parts are merged
in streams, and what reaches the driver is one table.  Integers make the result independent of
partitions and of the order in which tasks end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PART = 4096
AT_ONCE = 16 << 20  # bytes of a table that is read in one job; larger ones go by partition
SCHEMA = "part int, counts binary"


def _rows(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["part", "counts"])


def padded(size: int) -> int:
    """The length of a table of ``size`` entries: whole parts."""
    return -(-size // PART) * PART


def emitted(table: np.ndarray):
    """The parts of a task's table that aren't zero, a few at a time, as longs."""
    rows = table.reshape(-1, PART)
    used = np.flatnonzero(rows.any(1))
    for lo in range(0, len(used), 32):
        yield _rows({int(p): rows[p].astype(np.int64) for p in used[lo : lo + 32]})


def merged(emitted_rows: DataFrame, size: int, merge: np.ufunc = np.add) -> np.ndarray:
    """The table of ``size`` longs from the rows that the tasks emitted."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(raw, np.int64)
                sums[part] = merge(sums[part], x) if part in sums else x
        if sums:
            yield _rows(sums)

    out = np.zeros((padded(size) // PART, PART), np.int64)
    found = emitted_rows.repartition("part").mapInArrow(run, SCHEMA)
    # An iterator holds one partition at a time, but starts a job for each.
    rows = zip(*(c.to_pylist() for c in found.toArrow().columns)) if out.nbytes <= AT_ONCE else ((r["part"], bytes(r["counts"])) for r in found.toLocalIterator())
    for part, raw in rows:
        out[part] = merge(out[part], np.frombuffer(raw, np.int64))
    return out.ravel()[:size]
