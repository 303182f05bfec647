"""Vectors as integers: floor(256 * x) per component, exact from there on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

STEPS = 256
#: Components beyond this count as this much, so that scores, distances and a hundred times either fit a long.
LARGEST = 1 << 24


def finite_rows(column: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, flat, lengths) of the vectors that are not null and hold finite numbers only; of ``size`` components, if given."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
    fit = column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - lengths])
    if size is not None:
        fit &= lengths == size
    return np.flatnonzero(fit), flat[np.repeat(fit, lengths)], lengths[fit]


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) in doubles, as int32."""
    return np.clip(np.floor(STEPS * values), -LARGEST, LARGEST).astype(np.int32)


def binary_rows(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as Arrow binary values."""
    m = np.ascontiguousarray(m)
    width = m.dtype.itemsize * m.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(np.arange(len(m) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(m)])


def matrix_of(column: pa.Array, size: int, dtype) -> np.ndarray:
    """The matrix whose rows an Arrow binary column holds."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), size)
