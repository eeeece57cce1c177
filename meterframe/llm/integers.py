"""Vectors as whole numbers: scaled components, and products of them that are exact at any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components beyond this count as this, so that scaled ones are longs.
FAR = float(1 << 47)
_DOUBLE, _LONG = 1 << 53, 1 << 62


def finite(vector: str) -> Column:
    """Whether a vector is there and holds no null and no component that is not finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def scaled(vector: str, by: int) -> Column:
    """floor(by * x) of each component x, as longs. ``by`` is a power of two, so that no product is rounded."""
    return F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), x)) * float(by)).cast("long"))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The rows of a list column as longs; shorter rows end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths(), np.int64)
    values = np.asarray(column.flatten(), np.int64)
    if (lengths == size).all():
        return values.reshape(len(lengths), size)
    out = np.zeros((len(lengths), size), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def most(*arrays: np.ndarray) -> int:
    """The largest magnitude in the arrays."""
    return max((max(abs(int(a.max())), abs(int(a.min()))) for a in arrays if a.size), default=0)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T without rounding: in doubles where these hold every sum, else in longs, else in Python's integers."""
    bound = most(a) * most(b) * max(1, a.shape[1])
    if bound < _DOUBLE:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T if bound < _LONG else a.astype(object) @ b.astype(object).T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The squared distance of each row of ``a`` to each row of ``b``, without rounding."""
    if 4 * most(a, b) ** 2 * max(1, a.shape[1]) >= _LONG:
        a, b = a.astype(object), b.astype(object)
        return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    return (a * a).sum(axis=1)[:, None] - 2 * products(a, b) + (b * b).sum(axis=1)[None, :]
