"""Vectors from array columns, as matrices of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(column: str) -> Column:
    """Whether an array is there and holds neither nulls nor non-finite numbers."""
    x = F.col(column)
    return F.coalesce(~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))), F.lit(False))


def matrix(rows: pa.Array, width: int) -> np.ndarray:
    """Arrays of one length as the rows of a matrix."""
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)


def lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as arrays."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.reshape(-1)))


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers: in doubles where these hold every sum exactly, or else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T
