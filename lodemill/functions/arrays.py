"""Arrow columns of arrays as NumPy matrices and back, without a Python object for any element."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many places are an expression of the plan; more travel with a function.
INLINE = 64


def matrix(col: pa.Array) -> np.ndarray:
    """One row for each array, all of one width; null elements are NaN."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def lists(m: np.ndarray) -> pa.ListArray:
    """The rows as arrays of doubles; NaN is null."""
    n, p = m.shape
    flat = np.ascontiguousarray(m, float).ravel()
    values = pa.array(flat, pa.float64(), mask=np.isnan(flat))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p), values)


def byte_rows(codes: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes as binary values."""
    n, p = codes.shape
    ends = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * p)
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(np.ascontiguousarray(codes))])


def byte_matrix(col: pa.Array) -> np.ndarray:
    """One row for each binary value, all of one length."""
    if not len(col):
        return np.zeros((0, 0), np.uint8)
    ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(col), -1)


def take(x: Column, places: list[int]) -> Column:
    """Elements of an array of doubles at 0-based ``places``, in that order; null beyond its end.

    Many places, as of a wide matrix, don't go into the plan: they travel with an Arrow function.
    """
    if len(places) <= INLINE:
        return F.transform(F.array(*map(F.lit, places)), lambda i: F.get(x, i)) if places else F.slice(x, 1, 0)
    at = np.array(places, np.int64)

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            ends = b.offsets.to_numpy().astype(np.int64)
            place = ends[:-1, None] + at
            place = np.where(place < ends[1:, None], place, -1).ravel()
            values = b.values.take(pa.array(place, pa.int64(), mask=place < 0))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * len(at)), values)

    return run(x.cast("array<double>"))
