"""What the training-data operators share: shared-folder tables, Arrow helpers, md5 keys.

Nothing here keeps state on an executor.  A table that is needed twice is written
to the folder that the cluster names in ``spark.checkpoint.dir`` and read again, so a
lost executor costs a re-read, not a re-run of the lineage above it.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.sources.streams import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table that ``materialize`` wrote and that no later plan reads."""
    path = getattr(df, "_shared_path", None)
    if path is None:
        return
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; what came of them is in the shared folder."""
    gc.collect()
    spark._jvm.System.gc()


def slices(texts: Iterable, limit: int, size=len) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive items whose sizes add up to about ``limit``."""
    start, total, n = 0, 0, 0
    for n, x in enumerate(texts, 1):
        total += size(x) if x is not None else 0
        if total >= limit:
            yield start, n
            start, total = n, 0
    if start < n:
        yield start, n


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(","))])


def md5_number(text: Column, digits: int = 12) -> Column:
    """The first hexadecimal digits of the md5 of a string, as a bigint."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("bigint")


def _digest(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def clashing_ids(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """(__of): the ids that rows of different texts share; None if there are none."""
    digest = _digest(text_col)
    clashes = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__of")).agg(F.min(digest).alias("low"), F.max(digest).alias("high")).where("low <> high").select("__of")
    return None if clashes.isEmpty() else materialize(clashes, "clashes")


def with_variant(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "variant") -> DataFrame:
    """``rows`` and a bigint that tells texts of one id apart: 0 where an id has one text, else the text's 64-bit hash.

    (id, variant) so names a text, whenever and wherever the row is read; rows that are equal in both share it.
    """
    known, none = clashing_ids(rows, id_col, text_col), F.lit(0).cast("bigint")
    if known is None:
        return rows.withColumn(out, none)
    return rows.join(known, F.col(id_col) == F.col("__of"), "left").withColumn(out, F.when(F.col("__of").isNotNull(), _digest(text_col)).otherwise(none)).drop("__of")


def as_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that helper columns beside it can have any name."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns))
