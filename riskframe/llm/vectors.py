"""Vectors of one length as numpy rows inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Rows per numpy step, which bounds what a step holds.
STEP_ROWS = 4096


def whole_vector(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def vector_rows(vectors: DataFrame, key: str, vector: str, *others: str) -> DataFrame:
    """(id long, v array<double>, others) of the rows whose vector is whole."""
    rows = vectors.select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), *[F.col(c) for c in others]
    )
    return rows.filter(whole_vector(F.col("v")))


def first_length(rows: DataFrame) -> int | None:
    """Length of the vector with the smallest id (the shortest of several); null ids come last."""
    row = rows.agg(F.min(F.struct(F.col("id").isNull(), "id", F.size("v").alias("d"))).alias("m")).first()
    return row["m"]["d"] if row["m"] is not None else None


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """The vectors of an Arrow column, all of ``length``, as float64 rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(len(column), length)
