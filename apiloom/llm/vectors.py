"""Whole-number vectors: which rows count, and their components as integers inside tasks."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

MOST = (1 << 63) - 1


def vectors_of(rows: DataFrame, vec_col: str) -> Column:
    """The column as an array of floating-point numbers."""
    kind = rows.schema[vec_col].dataType
    plain = isinstance(kind, ArrayType) and isinstance(kind.elementType, (FloatType, DoubleType))
    return F.col(vec_col) if plain else F.col(vec_col).cast("array<double>")


def is_finite(vec: Column) -> Column:
    """Not null, and no component that is null, NaN or infinite."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def limit_of(n: int) -> int:
    """The largest component for which n squared differences add up to less than 2^63."""
    return isqrt(MOST // (4 * max(1, n)))


def whole(values: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """floor(scale * x), held at +-limit."""
    return np.clip(np.floor(values.astype(np.float64) * scale), -limit, limit).astype(np.int64)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Lists of `size` numbers each as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def attach(rows: DataFrame, totals: DataFrame, on: str, *, max_rows: int = 1_000_000) -> DataFrame:
    """Left join to one row a key, null keys included: by a broadcast when `totals` was counted to be at most `max_rows`,
    else by a sort-merge join, whose hot keys adaptive execution splits."""
    few = totals.limit(max_rows + 1).count() <= max_rows
    side = totals.withColumnRenamed(on, "__key")
    return rows.join(F.broadcast(side) if few else side, F.col(on).eqNullSafe(F.col("__key")), "left").drop("__key")
