"""Arrow batches in parts of bounded text, for what must be done in Python.

Spark ends a batch at 10,000 rows or 64 MB; as Python strings, with copies at each
step of a rule, that is many times as much.  A part holds a few megabytes of text, so
what a worker needs besides the batch itself doesn't depend on the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a part is meant to hold; one text may be longer.
PART_BYTES = 2 << 20


def bounds(texts: pa.Array, most: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of successive parts of at most `most` bytes, or of one text above that."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, end - at
        at = end


def parts(batch: pa.RecordBatch, column: int, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    for at, n in bounds(batch.column(column), most):
        yield batch.slice(at, n)


def mapped(texts: pa.Array, rule, most: int = PART_BYTES) -> pa.Array:
    """rule of every text (None of a null one) as an array of strings, a part at a time."""
    done = [pa.array([rule(v) for v in texts.slice(at, n).to_pylist()], pa.string()) for at, n in bounds(texts, most)]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())
