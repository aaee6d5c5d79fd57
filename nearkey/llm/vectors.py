"""What the two vector operators share: which vectors count, and the cosine they are judged by."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, *carry: str) -> DataFrame:
    """``vec_id, *carry, v, dim`` of rows with an id and a finite vector that is not zero."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    rows = vectors.where(v.isNotNull() & F.col("vec_id").isNotNull()).where(~bad & some)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), *carry, v.alias("v"), F.size(v).alias("dim"))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of equally long lists as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``a`` with those of ``b``, in double, summed from the first component on.

    Whatever the batching, a pair has one value (as a sequential SQL aggregate has it too).
    """
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for i in range(a.shape[1]):
        x, y = a[:, i], b[:, i]
        dot += x * y
        aa += x * x
        bb += y * y
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def unit(a: np.ndarray) -> np.ndarray:
    return a / np.sqrt((a * a).sum(1))[:, None]
