"""Vectors in tables: which take part, packed tiles of them, and numpy views of both."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    values = vector.cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(values, lambda x: x != 0), F.lit(False))


def doubles(vector: Column) -> Column:
    """The vector in double precision, with one zero (-0.0 becomes 0.0)."""
    return F.transform(vector.cast("array<double>"), lambda x: x + F.lit(0.0))


def one_length(vectors: DataFrame, column: str) -> int | None:
    """The number of components, the same for all rows (None: no rows)."""
    row = vectors.agg(F.min(F.size(column)).alias("low"), F.max(F.size(column)).alias("high")).first()
    if row["low"] != row["high"]:
        raise ValueError(f"vectors of {row['low']} to {row['high']} components cannot be compared")
    return row["low"]


def packed(rows: np.ndarray) -> bytes:
    """Bytes of an array; doubles that are single-precision values are packed as those, without loss."""
    if rows.dtype == np.float64:
        with np.errstate(over="ignore"):
            short = rows.astype(np.float32)
        if (short == rows).all():
            rows = short
    return np.ascontiguousarray(rows).tobytes()


def matrix(raw: bytes, count: int, width: int) -> np.ndarray:
    """``count`` packed vectors, in double precision."""
    kind = np.float32 if len(raw) == 4 * count * width else np.float64
    return np.frombuffer(raw, kind).reshape(count, width).astype(np.float64)


def longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)
