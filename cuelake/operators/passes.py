"""One pass over the rows of each key in order, for rules whose state depends on what they decided before.

Spark deals the keys and sorts; a task streams its rows through a small generator, so memory does not grow with a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS_OUT = 10_000


def ordered_pass(df: DataFrame, keys: list[str], order: list[str], rule: Callable[[Iterator[tuple]], Iterator[tuple]], schema: StructType, tasks: int | None = None) -> DataFrame:
    """``rule`` gets the rows of ``df`` as tuples, whole keys one after another, each in order, and yields rows of ``schema``; with ``tasks`` in so many."""
    ordered = df.repartition(*([tasks] if tasks else []), *keys).sortWithinPartitions(*keys, *order)
    out = to_arrow_schema(schema)

    def run(batches):
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        made = rule(rows)
        while part := list(islice(made, ROWS_OUT)):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part, strict=True), out, strict=True)], schema=out)

    return ordered.mapInArrow(run, schema)
