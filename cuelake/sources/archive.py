"""Statistics lines, run archives, probes and file inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATS = "task_id string, created_at timestamp, timestamp timestamp, status string, transcription_model string, translation_service string, total_duration double, video_duration double, translation_tokens bigint, translation_cost_usd double, cps_over_budget int"


def read_stats_jsonl(spark: SparkSession, path: str, schema: str = STATS) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON lines; blank lines are neither.  The schema is fixed, so older lines have nulls."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.withColumn("x", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("x._bad is null").select("x.*").drop("_bad"), parsed.where("x._bad is not null").select(F.col("value").alias("line"))


def append_stats(df: DataFrame, path: str) -> None:
    """Append as JSON lines, stamped now where there is no timestamp."""
    now = F.current_timestamp()
    stamped = df.withColumn("timestamp", F.coalesce("timestamp", now)) if "timestamp" in df.columns else df.withColumn("timestamp", now)
    stamped.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def stats_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, entries) of the files of a folder of JSON lines."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), "value")
    return rows.groupBy("file", "size").agg(F.count_if(F.trim("value") != "").alias("entries"))


def export_csv(df: DataFrame, path: str) -> None:
    """Flat export; nested columns become JSON."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_archive(df: DataFrame, path: str, stage: str) -> None:
    """Append one stage of runs (column run_id); nothing is ever overwritten, an empty table writes no partition."""
    df.withColumn("stage", F.lit(stage)).write.mode("append").partitionBy("run_id", "stage").parquet(path)


def build_run_index(meta: DataFrame) -> DataFrame:
    """``cues`` of a run: those after the last stage, else its segments (0 counts as none)."""
    return meta.withColumn("cues", F.coalesce(F.nullif(F.col("cue_counts")["post_reflow"], F.lit(0)), F.col("segments_count")))


def file_inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, folder, length, modificationTime) from file metadata alone; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "length", "modificationTime")


def retention_report(files: DataFrame, days: int, now=None) -> DataFrame:
    """Files past the limit of days by folder, and the bytes they hold; nothing is deleted."""
    limit = (now if now is not None else F.current_timestamp()) - F.expr(f"interval {days} days")
    return files.where(F.col("modificationTime") < limit).groupBy("folder").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


STREAM = "array<struct<codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string>>"
# Media types by extension.
MEDIA_TYPES = {".mp4": "video/mp4", ".mkv": "video/x-matroska", ".webm": "video/webm", ".avi": "video/x-msvideo", ".mov": "video/quicktime", ".mp3": "audio/mpeg", ".wav": "audio/wav"}


def read_probe_json(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, rejects) of probe output (filename, probe): size, rate and codecs of the first video and audio streams; rejects have neither."""
    d = df.withColumn("__p", F.from_json("probe", f"streams {STREAM}, format struct<duration:string,bit_rate:string>"))
    first = lambda kind: F.get(F.filter("__p.streams", lambda s: s["codec_type"] == kind), F.lit(0))
    d = d.withColumn("__v", first("video")).withColumn("__a", first("audio"))
    rate = F.transform(F.split("__v.r_frame_rate", "/"), lambda x: x.try_cast("int"))
    num, den = F.get(rate, F.lit(0)), F.get(rate, F.lit(1))
    kind = F.coalesce(F.create_map(*(F.lit(x) for p in MEDIA_TYPES.items() for x in p))[F.lower(F.regexp_extract("filename", r"(\.[^.]+)$", 1))], F.lit("application/octet-stream"))
    good = d.where("__v is not null or __a is not null").select(
        "filename", F.coalesce("__v.width", F.lit(0)).alias("width"), F.coalesce("__v.height", F.lit(0)).alias("height"), F.coalesce(F.when(den > 0, F.round(num / den, 2)), F.lit(0.0)).alias("fps"),
        F.round(F.coalesce(F.col("__p.format.duration").try_cast("double"), F.lit(0.0)), 2).alias("duration"), F.coalesce("__v.codec_name", F.lit("unknown")).alias("codec"), F.coalesce("__a.codec_name", F.lit("none")).alias("audio_codec"), kind.alias("mime_type"),
    )
    return good, d.where("__v is null and __a is null").select(df.columns)
