"""What the operators on vectors share: which rows count, and vectors as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integers beyond this are refused, so that no sum of squares leaves 64 bits.
LARGEST = 1 << 29


def usable(table: DataFrame, *more: str, parts: int = 1) -> DataFrame:
    """vec_id, the further columns and the vector of rows whose vector is not null and holds neither nulls nor non-finite entries.

    All vectors have one length: of those that `parts` divides the most frequent, the longer if two are.
    Rows of other lengths go.
    """
    whole = F.expr("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    rows = table.filter(F.col("embedding").isNotNull()).filter(whole).select(
        F.col("vec_id").cast("long").alias("vec_id"), *more, F.col("embedding").cast("array<double>").alias("embedding"))
    lengths = rows.groupBy(F.size("embedding").alias("size")).count().filter((F.col("size") > 0) & (F.col("size") % parts == 0))
    first = lengths.orderBy(F.desc("count"), F.desc("size")).first()
    return rows.filter(F.size("embedding") == (first["size"] if first else -1))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The lists of a column as rows; all have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers. Scale is a power of two, so the product is exact."""
    y = np.floor(x * float(scale))
    if y.size and np.abs(y).max() >= LARGEST:
        raise ValueError(f"vector entries of {LARGEST / scale:g} or more are not supported")
    return y.astype(np.int64)
