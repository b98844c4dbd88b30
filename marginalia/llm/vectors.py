"""Vector columns: which rows hold whole finite vectors, and their values as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there, not empty, and free of null and non-finite components."""
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & whole, F.lit(False))


def common_size(rows: DataFrame, vector: Column, multiple: int = 1) -> int:
    """The length that most vectors have (the least of several); 0 if there is none.

    Only lengths that ``multiple`` divides count.
    """
    sizes = rows.select(F.size(vector).alias("s")).filter((F.col("s") > 0) & (F.col("s") % multiple == 0))
    found = sizes.groupBy("s").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "s").first()
    return found["s"] if found else 0


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The vectors of a list column without nulls, one per row, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)
