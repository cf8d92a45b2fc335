"""Helpers for embedding columns: validity, packing to bytes, and back to matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there, not empty, and holds finite numbers only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def packed(df: DataFrame, keep: list[str], vector_col: str, out: str = "vec") -> DataFrame:
    """``keep`` and the vector as bytes of 64-bit floats."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    def run(batches):
        for b in batches:
            lists = b.column(b.num_columns - 1)
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            cells = [flat[p:q].tobytes() for p, q in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(cells, pa.binary())], names=[*b.schema.names[:-1], out])

    rows = df.select(*keep, F.col(vector_col).cast("array<double>").alias("__v"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField(out, BinaryType())]))


def matrix(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), -1)
