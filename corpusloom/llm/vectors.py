"""Shared pieces of the embedding operators: which vectors count, one per id, packed as bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def prepared(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, dim, v) of the usable vectors, v holding the components; an id that repeats keeps its least vector."""
    single = dict(df.dtypes)[vector] == "array<float>"
    rows = df.select(F.col(key).alias("id"), (F.col(vector) if single else F.col(vector).cast("array<double>")).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    return rows.groupBy("id").agg(F.min("v").alias("v")).select("id", F.size("v").alias("dim"), "v")


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column of equal length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, dim)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision; equal rows give equal results wherever they stand."""
    return (a * b).sum(axis=1)
