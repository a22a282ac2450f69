"""Vectors of an Arrow list column as numpy matrices, and whole numbers as compact bytes.

Rows whose vector is null, or holds a null, an infinite or a not-a-number entry, are left out; so are rows with an entry
whose scaled value lies beyond 2^53, as no double states its whole part.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LIMIT = 2.0**53


def doubles(table: DataFrame, column: str, *keep: str) -> DataFrame:
    """The kept columns and `vector`, an array of doubles."""
    return table.select(*keep, F.col(column).cast("array<double>").alias("vector"))


def usable(vector: Column) -> Column:
    """No null, infinite or not-a-number entry in an array of doubles that is not null itself."""
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def matrices(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and floor(scale * entry) of the usable rows, one matrix of int64 per vector length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    there = ~np.asarray(column.is_null())
    offsets = np.asarray(column.offsets, dtype=np.int64)
    values = column.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)     # nulls become not-a-number
    with np.errstate(invalid="ignore", over="ignore"):
        flat = np.floor(flat * scale)
        bad = ~(np.abs(flat) < LIMIT)
    faults = np.concatenate([[0], np.cumsum(bad)])
    size = np.diff(offsets)
    there &= faults[offsets[1:]] == faults[offsets[:-1]]
    for length in np.unique(size[there]):
        rows = np.flatnonzero(there & (size == length))
        at = offsets[rows][:, None] + np.arange(length)
        yield rows, flat[at].astype(np.int64)


def to_bytes(x: np.ndarray) -> list[bytes]:
    """Rows of whole numbers, each in the narrowest of 2, 4 or 8 bytes a number that holds all of it."""
    out: list[bytes] = [b""] * len(x)
    if not x.size:
        return out
    most = np.maximum(x.max(1), -1 - x.min(1))
    width = np.where(most < 2**15, 2, np.where(most < 2**31, 4, 8))
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        data, step = x[rows].astype(f"<i{w}").tobytes(), int(w) * x.shape[1]
        for i, row in enumerate(rows):
            out[row] = data[i * step:(i + 1) * step]
    return out


def from_bytes(rows: list[bytes], dims: int) -> np.ndarray:
    """The matrix of int64 that `to_bytes` wrote."""
    x = np.zeros((len(rows), dims), np.int64)
    if not dims:
        return x
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x[at] = np.frombuffer(b"".join([rows[i] for i in at]), f"<i{size // dims}").reshape(len(at), dims)
    return x


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x^T y of whole numbers, exact: in doubles while every sum stays below 2^53, else in Python's integers."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * max(1, len(x))
    if most < 2**53:
        return (x.astype(np.float64).T @ y.astype(np.float64)).astype(np.int64)
    return x.astype(object).T @ y.astype(object)
