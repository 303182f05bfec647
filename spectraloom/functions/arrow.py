"""Bridges between Arrow list columns and NumPy matrices, used inside Arrow UDFs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def to_matrix(col) -> tuple[np.ndarray, np.ndarray]:
    """(valid mask, dense float64 matrix of the valid rows) of an equal-length list column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    valid = ~np.asarray(col.is_null())
    kept = col if valid.all() else col.filter(pa.array(valid))
    flat = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    rows = len(kept)
    if rows and flat.size % rows:
        raise ValueError("vectors of different lengths in one column")
    return valid, flat.reshape(rows, -1) if rows else np.empty((0, 0))


def spread(valid: np.ndarray, values: np.ndarray) -> pa.Array:
    """Put the values of the valid rows back in place, null elsewhere."""
    if valid.all():
        return pa.array(values)
    out = np.zeros(len(valid), dtype=values.dtype)
    out[valid] = values
    return pa.array(out, mask=~valid)


def to_list_array(matrix: np.ndarray, value_type=None) -> pa.ListArray:
    """Dense matrix to a list column without a Python loop."""
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel(), type=value_type))


def normalize_rows(m: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + eps)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length; zero rows stay zero."""
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
