"""Arrow list columns as numpy matrices and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Share of the squared lengths below which a squared distance is taken directly, and how many pairs at a time; distances and columns of a tile.
CLOSE, DIRECT, TILE, COLUMNS = 1e-6, 1 << 14, 1 << 16, 512


def to_matrix(column: pa.Array | pa.ChunkedArray, dim: int | None = None, kind: type = np.float64) -> np.ndarray:
    """Rows of equal length as a matrix; a NULL row or one of another length is an error, never a shift of the others."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros((0, dim or 0))
    if column.null_count:
        raise ValueError(f"{column.null_count} of {n} vectors are NULL")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    width = len(flat) // n
    if (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError("vectors differ in length")
    return flat.reshape(n, width)


def from_matrix(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, d = rows.shape
    offsets = pa.array(np.arange(0, n * d + 1, d if d else 1, dtype=np.int32)[: n + 1])
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).ravel(), type=kind))


def distances(a: np.ndarray, b: np.ndarray, same: bool = False) -> np.ndarray:
    """Euclidean distances between the rows of two blocks.

    Both are moved to the mean of ``b`` first, so that points far from the
    origin keep their digits; pairs so close that the product form would lose
    them are subtracted directly.
    """
    if len(a) and len(b):
        middle = b.mean(axis=0)
        a, b = a - middle, b - middle
    long_a, long_b = (a * a).sum(1), (b * b).sum(1)
    out = np.empty((len(a), len(b)))
    for left in range(0, len(b), COLUMNS):  # tiles that stay in a core's cache
        other, long_other = b[left:left + COLUMNS], long_b[left:left + COLUMNS]
        rows = max(1, TILE // len(other))
        for low in range(0, len(a), rows):
            part = a[low:low + rows]
            lengths = long_a[low:low + rows, None] + long_other
            squared = part @ other.T
            squared *= 2.0
            np.subtract(lengths, squared, out=squared)
            lengths *= CLOSE
            near = squared < lengths
            if near.any():
                r, c = np.nonzero(near)
                for at in range(0, len(r), DIRECT):
                    i, j = r[at:at + DIRECT], c[at:at + DIRECT]
                    squared[i, j] = ((part[i] - other[j]) ** 2).sum(1)
            np.maximum(squared, 0.0, out=squared)
            np.sqrt(squared, out=out[low:low + rows, left:left + COLUMNS])
    if same:
        np.fill_diagonal(out, 0.0)
    return out
