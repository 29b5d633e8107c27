"""What the operators on embeddings share: valid vectors, and classes of equal ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(vector: Column) -> Column:
    """Not null, not empty, all components present and finite, and not the zero vector."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def keyed(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>, cid): cid identifies a vector's value, and is null
    for vectors that take no part."""
    vector = F.col("embedding").cast("array<double>")
    d = embeddings.select("vec_id", vector.alias("embedding"))
    return d.withColumn("cid", F.when(valid(F.col("embedding")), F.xxhash64(F.size("embedding"), "embedding")))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the same row of y, in doubles."""
    return (units(x) * units(y)).sum(axis=1)
