"""Vectors as rows: which take part, and numpy views of Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require


def usable(vector: Column) -> Column:
    """Whether a vector is neither null, empty nor zero and holds only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def as_doubles(df: DataFrame, vector: str = "embedding") -> Column:
    """The vector with double components; -0.0 becomes 0.0, so equal vectors are alike."""
    require(df, vector)
    return F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equally long vectors as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.empty((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a power of two is taken out first, so squares don't overflow."""
    if not x.size:
        return x
    x = x / np.exp2(np.floor(np.log2(np.abs(x).max(axis=1, keepdims=True))))
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def as_floats(df: DataFrame, vector: str = "embedding") -> Column:
    """The vector with single-precision components where the column holds such, else double ones.

    -0.0 becomes 0.0, so equal vectors are alike.
    """
    require(df, vector)
    kind = "float" if df.schema[vector].dataType.simpleString() == "array<float>" else "double"
    return F.transform(F.col(vector), lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
