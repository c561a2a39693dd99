"""Vectors as blocks of whole numbers, shared by the vector operators.

A component x becomes the integer floor(scale * x), so sums and squared
distances are exact and no result depends on how rows are dealt out. A block
holds some thousand vectors as one array of the smallest integer type that fits.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vectors of a block.
BLOCK = 4096


def finite(vector: Column) -> Column:
    """True where the vector is there and all its components are numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64; an error where that does not fit."""
    out = np.floor(x.astype(np.float64) * scale)
    if out.size and np.abs(out).max() >= 2.0**62:
        raise ValueError("a component is too large for exact distances")
    return out.astype(np.int64)


def integers(column: pa.Array, scale: int) -> np.ndarray:
    """(rows, components) of a list column without nulls, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return whole(flat, scale).reshape(len(column), len(flat) // max(len(column), 1))


def shrunk(x: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest signed type that holds them."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(np.result_type(np.min_scalar_type(min(low, -1)), np.min_scalar_type(min(-high - 1, -1))))


def number_type(dimension: int, *arrays: np.ndarray) -> type:
    """The type in which distances of such numbers are exact: doubles, which
    multiply fast, up to 2**53, longs beyond; an error where those overflow."""
    most = max((int(np.abs(x).max()) for x in arrays if x.size), default=0)
    bound = 8 * max(dimension, 1) * most**2
    if bound >= 1 << 63:
        raise ValueError("a component is too large for exact distances")
    return np.float64 if bound < 1 << 53 else np.int64


def pack(x: np.ndarray) -> bytes:
    """An array with its type and shape."""
    out = io.BytesIO()
    np.save(out, x, allow_pickle=False)
    return out.getvalue()


def unpack(x: bytes) -> np.ndarray:
    return np.load(io.BytesIO(x), allow_pickle=False)


def slices(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``most`` rows at most."""
    for batch in batches:
        for first in range(0, batch.num_rows, most):
            yield batch.slice(first, most)
