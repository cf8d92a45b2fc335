"""Micro-batch sources and a sink that a batch query can read."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_event_stream(spark: SparkSession, folder: str, schema: str = EVENTS, name: str = "events.parquet", files_per_batch: int | None = None) -> DataFrame:
    """A table of a folder, one file or a folder of part files, as a stream; ``ts`` is event time.

    What is there at the start is one micro-batch, unless ``files_per_batch`` is given: files in no order of time, read
    one after another, would leave rows behind the watermark.
    """
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    stream = source.parquet(f"{folder}/{name}*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


#: the streams of the engine, each with event time ``ts``
STREAMS = {
    "progress": "task_id string, ts timestamp, step_index int, weight double, status string, progress bigint, message string",
    "transfer": "task_id string, ts timestamp, downloaded_bytes bigint, total_bytes bigint",
    "usage": "key string, ts timestamp, tokens bigint",
    "token": "token string, ts timestamp, action string, filename string",
}


def read_stream(spark: SparkSession, kind: str, folder: str, form: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """One of ``STREAMS`` from a folder of files of JSON lines or Parquet, in which files appear whole and don't change.

    Each file is read once, restarts included.  A line that is no JSON is left out; a field that is missing or of another type is null.
    """
    if form not in ("json", "parquet"):
        raise ValueError(f"no such form: {form}")
    source = spark.readStream.schema(STREAMS[kind] + (", _bad string" if form == "json" else "")).format(form)
    if form == "json":
        source = source.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    rows = source.load(folder)
    return rows.where("not (_bad is not null and ts is null)").drop("_bad") if form == "json" else rows


_folders: dict[str, str] = {}


def _remove(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    with contextlib.suppress(Exception):  # the session may be going down already
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the one that the cluster names in ``spark.checkpoint.dir``; a temporary one in local mode only.

    Results are read from it as long as the application lives; it is removed when the driver ends.
    """
    context = spark.sparkContext
    if context.applicationId not in _folders:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{named.rstrip('/')}/{context.applicationId}-{uuid.uuid4().hex[:8]}" if named else "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        _folders[context.applicationId] = folder
        atexit.register(_remove, spark, folder)
    return _folders[context.applicationId]


def closing_marks(spark: SparkSession, like: DataFrame, **values) -> tuple[DataFrame, Callable[[int], None]]:
    """A stream of marks with the columns of ``like``, and what puts the k-th one there: a row of ``values``, k + 1 days after 2100; of arrays, if columns are."""
    folder = f"{shared_folder(spark)}/marks-{uuid.uuid4().hex}"
    none = spark.createDataFrame([], like.schema)
    none.coalesce(1).write.parquet(folder)

    def put(k: int) -> None:
        row = {**dict.fromkeys(like.columns), **values, "ts": datetime(2100, 1, k + 1, tzinfo=timezone.utc)}
        row = {c: [v] if isinstance(like.schema[c].dataType, ArrayType) else v for c, v in row.items()}
        spark.createDataFrame([tuple(row[c] for c in like.columns)], like.schema).coalesce(1).write.mode("append").parquet(folder)

    return spark.readStream.schema(like.schema).option("pathGlobFilter", "*.parquet").parquet(folder), put


def into_table(base: str, each: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: rows (after ``each``) go to the batch's own part of a table, so a batch that comes twice is there once."""

    def put(batch: DataFrame, batch_id: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    return put


def table_of(spark: SparkSession, base: str, schema: StructType) -> DataFrame:
    """The table that ``into_table`` wrote, with batch_id."""
    whole = StructType([*schema.fields, StructField("batch_id", IntegerType())])
    return spark.read.schema(whole).option("basePath", f"{base}/out").parquet(f"{base}/out")


def run_available(stream: DataFrame, mode: str = "append", close: Callable[[int], None] | None = None, base: str | None = None, each: Callable[[DataFrame], DataFrame] | None = None, schema: StructType | None = None) -> DataFrame:
    """Run a stream over all that is there now and return every row it emitted, with its batch_id.

    Rows go to a table in the shared folder, not to the driver; a batch that is run again replaces its own rows.
    With ``close`` the input is then closed: it is called twice to put marks far ahead in event time, after each of
    which the stream runs on, so timers of all keys fire and what is held is emitted.  A ``base`` folder that was used before goes on
    from its checkpoint.  ``each`` turns a micro-batch into the rows that are kept, of ``schema``.
    """
    spark = stream.sparkSession
    base = base or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for k in range(3 if close else 1):
        if k:
            close(k - 1)
        run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(into_table(base, each)).start()
        run.awaitTermination()
    return table_of(spark, base, schema or stream.schema)


def latest(emitted: DataFrame, keys: list[str]) -> DataFrame:
    """The last emitted row of each key of a stream in update mode."""
    rest = [c for c in emitted.columns if c not in (*keys, "batch_id")]
    last = emitted.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("__last"))
    return last.select(*keys, *(F.col(f"__last.{c}").alias(c) for c in rest))
