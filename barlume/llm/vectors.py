"""Vectors as whole numbers, shared by the operators over embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SCALE = 256.0
LONG = 2**63 - 1


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""

    def number(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.coalesce(vector.isNotNull() & F.forall(vector, number), F.lit(False))


def whole(vector: Column) -> Column:
    """floor(256 * entry) as longs; beyond the range of a long its limit."""
    return F.transform(vector, lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("long"))


def smallest(rows: DataFrame, n: int) -> list[list[int]]:
    """The ``x`` of the ``n`` rows of smallest ``id`` (null ids last, equal ids by vector)."""
    return [r.x for r in rows.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(n).collect()]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors that are not null, one a row."""
    return np.asarray(column.flatten()).astype(np.int64).reshape(-1, width)


def blocks(batches: Iterator[pa.RecordBatch], width: int, cells: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``cells`` entries, so that memory does not follow the width."""
    rows = max(1, cells // max(1, width))
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
