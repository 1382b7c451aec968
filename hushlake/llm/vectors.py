"""What the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sound(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector isn't null, empty or zero and holds no null, NaN or infinite component, with it as ``v``, doubles."""
    v = F.col(column).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    none = F.forall(v, lambda x: x == 0)  # an empty one too
    return vectors.withColumn("v", v).where(F.col(column).isNotNull() & ~F.coalesce(odd, F.lit(True)) & ~none)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The rows of a list column, all of one width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width)
