"""Integer vectors from embeddings: Arrow lists to NumPy matrices and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def ragged(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of ``width`` doubles; short lists are filled with zeros, null entries are NaN."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def fixed(column: pa.Array, width: int) -> np.ndarray:
    """Lists that all have ``width`` entries and no nulls, without a copy where Arrow allows it."""
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, width)


def lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as Arrow lists."""
    starts = np.arange(len(matrix) + 1, dtype=np.int64) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.ascontiguousarray(matrix).reshape(-1), kind))


def whole(values: np.ndarray, factor: float, limit: int) -> np.ndarray:
    """floor(factor * value), held within plus or minus ``limit``."""
    return np.clip(np.floor(values * factor), -limit, limit).astype(np.int64)
