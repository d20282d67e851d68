"""Tables of vectors: which rows count, and their components as exact integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    x = lambda v: v.cast("double")
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < F.lit(float("inf"))))


def widest(vectors: DataFrame, vector_col: str) -> int:
    """Entries of the longest vector; 0 without rows. Shorter ones count as ending in zeros."""
    return vectors.agg(F.coalesce(F.max(F.size(vector_col)), F.lit(0))).first()[0]


def dense(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of an Arrow list column as doubles, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths == dims).all():
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims))
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value) as 64-bit integers; an error where one does not fit."""
    out = np.floor(values * scale)
    if out.size and np.abs(out).max() >= 2.0**62:
        raise ArithmeticError("a scaled component does not fit 62 bits")
    return out.astype(np.int64)
