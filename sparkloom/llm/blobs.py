"""Rows that carry packed arrays, so that a shuffle moves few rows with many values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def packed(group: np.ndarray, **columns: np.ndarray) -> dict[str, pa.Array]:
    """One row per distinct group number with each column's values as bytes, in their present order."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    out = {"group": pa.array(group[start].astype(np.int64))}
    bounds = np.r_[start, len(group)]
    for name, values in columns.items():
        values = np.ascontiguousarray(values[order])
        offsets = (bounds * (values.itemsize * int(np.prod(values.shape[1:])))).astype(np.int32)
        out[name] = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
    return out


def unpacked(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """All rows' values of a packed column, one after the other."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in column if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
