"""Small bridges between Arrow batches and numpy used inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A list column of equally long rows as a 2-D float64 array."""
    col = batch.column(column)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(batch.num_rows, -1)


def lists(rows: np.ndarray) -> pa.ListArray:
    """Rows of a 2-D array as an Arrow list column."""
    n, width = rows.shape
    offsets = np.arange(0, n * width + 1, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def square_distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """All squared distances through one matrix product."""
    d = (points * points).sum(1)[:, None] - 2.0 * points @ centers.T + (centers * centers).sum(1)
    return np.maximum(d, 0.0)
