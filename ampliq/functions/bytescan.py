"""Flat byte views of Arrow string and binary columns, for numpy kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def one_array(column) -> pa.Array:
    """The column as one Array of 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return column.cast(pa.large_string())
    return column.cast(pa.large_binary())


def flat(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid): row i holds bytes[offsets[i]:offsets[i + 1]]; a null row is empty and not valid."""
    array = one_array(column)
    n = len(array)
    valid = np.ones(n, bool) if array.null_count == 0 else array.is_valid().to_numpy(zero_copy_only=False)
    if not valid.all():
        array = array.fill_null("" if pa.types.is_large_string(array.type) else b"")
    _, offsets, data = array.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), valid
    ends = np.frombuffer(offsets, np.int64, n + 1, array.offset * 8)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0], valid


def binary_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of the rows data[offsets[i]:offsets[i + 1]]."""
    if len(data) < 2**31:
        return pa.Array.from_buffers(
            pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
        )
    return pa.array([data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values by row, wrapping as the dtype does."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row number of every element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def mix64(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
