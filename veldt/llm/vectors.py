"""What the vector operators share: reading rows of an embeddings table as a numpy matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Not null, not empty, no null and no non-finite component."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, ok)


def one_per_id(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", kind: str = "array<double>") -> DataFrame:
    """(vec_id, v): a row for each id that is not null, with components of `kind`; of rows that repeat an id the smallest vector."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("v")).filter("vec_id is not null")
    return v.groupBy("vec_id").agg(F.min("v").alias("v"))


def common_length(vectors: DataFrame) -> int:
    """The length that most vectors have, the smallest of equals; 0 for an empty table."""
    top = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return top["d"] if top else 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column without nulls, each list of length d, as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), d)


def lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel(), kind))


def spread(ids: np.ndarray) -> np.ndarray:
    """Well-mixed non-negative integers of ids, for dealing rows to blocks."""
    from veldt.llm.common import mix

    return (mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(2)).astype(np.int64)
