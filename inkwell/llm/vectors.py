"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable(vector: Column) -> Column:
    """Whether a vector is not null, not empty, not zero, and has only finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def of_common_size(rows: DataFrame, vector: str) -> DataFrame:
    """The rows whose vectors have the most frequent dimension (the smaller one in a tie)."""
    sizes = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size(vector) == (sizes.d if sizes else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(array):
        return np.zeros((0, 0))
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), -1)


def bounded_sample(rows: DataFrame, most: int, id_column: str, vector: str) -> np.ndarray:
    """At most ``most`` vectors, chosen by a hash of the id, in a fixed order."""
    found = rows.select(F.xxhash64(id_column).alias("h"), F.col(id_column).alias("i"), F.col(vector).alias("v")).orderBy("h", "i").limit(most).collect()
    return np.array([r.v for r in found], dtype=np.float64)
