"""Rows of vectors as matrices of doubles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

VECTORS = "uid long, id long, valid boolean, vector binary"


def numbered_vectors(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, type]:
    """A written table (uid, id, valid, vector: bytes), the vectors' dimension, and the components' type: float32 if the column has it, else float64.

    The dimension is the longest vector's; shorter ones end in zeros. Vectors
    that are null or hold null or non-finite components aren't valid and come
    as zeros. ``uid`` numbers the rows, so that repeated ids stay apart.
    """
    size = max(df.agg(F.max(F.size(vector_col))).first()[0] or 0, 1)
    single = isinstance(df.schema[vector_col].dataType.elementType, T.FloatType)
    dtype = np.float32 if single else np.float64
    plain = df.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            length = np.array([0 if x is None else x for x in pc.list_value_length(lists).to_pylist()], np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)
            row = np.repeat(np.arange(len(lists)), length)
            out = np.zeros((len(lists), size), dtype)
            out[row, np.arange(len(values)) - np.repeat(np.cumsum(length) - length, length)] = values
            valid = np.isfinite(out).all(axis=1) & ~lists.is_null().to_numpy(zero_copy_only=False)
            out[~valid] = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(valid), pa.array([x.tobytes() for x in out], pa.binary())], names=["uid", "id", "valid", "vector"])


    return written(plain.mapInArrow(convert, VECTORS), "vectors"), size, dtype


def matrix(column: pa.ChunkedArray | pa.Array, size: int, dtype: type) -> np.ndarray:
    """The vectors of a column of bytes as doubles, one per row."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in column]
    return np.concatenate(parts).astype(np.float64).reshape(-1, size) if parts else np.zeros((0, size))


def units(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length one; zeros stay. Dividing by the largest component first keeps squares in range."""
    biggest = np.abs(vectors).max(axis=1, initial=0)[:, None]
    vectors = vectors / np.where(biggest > 0, biggest, 1)
    length = np.linalg.norm(vectors, axis=1)[:, None]
    return vectors / np.where(length > 0, length, 1)
