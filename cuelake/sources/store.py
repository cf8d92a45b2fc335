"""A keyed store of job statistics: one row a task, a folder a day, states named by a manifest.

A commit writes new folders for the days and index buckets it touches and then, as its last act, one small manifest under the
next number.  Readers see the newest manifest, so an upsert is there wholly or not at all; what a failed one left behind is
named by no manifest.  Two writers that start from one state want the same number: the second fails and can try again.  For each day the manifest
lists models, services and statuses, so a read that asks for some of them, or for some days, opens those days alone.  The
index says on which day each task lies, in ``BUCKETS`` folders by hash: an upsert reads the buckets of its tasks and the days these name.

The manifest has a line a day, the only thing that the driver reads.  Creating a file only where there is none must be atomic in the
file system (HDFS and local disks do that).
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from cuelake.operators.jobstats import latest_per_task

BUCKETS, MOST_NAMES = 64, 256
LISTED = {"models": "transcription_model", "services": "translation_service", "statuses": "status"}


class CommitConflict(RuntimeError):
    """Another writer has committed since this one began."""


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    folder, fs = _path(spark, f"{path}/manifest")
    if not fs.exists(folder):
        return []
    names = (x.getPath().getName() for x in fs.listStatus(folder))
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The newest state, or that of a version; of a store that is not there an empty one."""
    known = versions(spark, path)
    if not known and version is None:
        return {"version": 0, "schema": None, "days": {}, "index": {}}
    number = known[-1] if version is None else version
    if number not in known:
        raise ValueError(f"no version {number} in {path}")
    file, fs = _path(spark, f"{path}/manifest/{number:010d}.json")
    stream = fs.open(file)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, state: dict) -> None:
    file, fs = _path(spark, f"{path}/manifest/{state['version']:010d}.json")
    try:
        stream = fs.create(file, False)
    except Exception as e:
        if fs.exists(file):
            raise CommitConflict(f"version {state['version']} of {path} is there already") from e
        raise
    stream.write(bytearray(json.dumps(state).encode()))
    stream.close()


def _read(spark: SparkSession, path: str, kind: str, part: StructField, schema: StructType, folders: list[str]) -> DataFrame:
    whole = StructType([*schema.fields, StructField("commit", StringType()), part])
    if not folders:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", f"{path}/{kind}").parquet(*(f"{path}/{f}" for f in folders))


def _days(spark: SparkSession, path: str, state: dict, days: list[str]) -> DataFrame:
    schema = StructType.fromJson(state["schema"])
    return _read(spark, path, "data", StructField("date", DateType()), schema, [state["days"][d]["folder"] for d in days]).drop("commit")


def read_stats(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, models: list[str] | None = None, services: list[str] | None = None, statuses: list[str] | None = None, version: int | None = None) -> DataFrame:
    """The store's rows, one a task, with their ``date``: of the days from first to last, of some models, services or statuses.

    Only days that may hold such rows are opened.  A store without any commit is an error, as its columns aren't known.
    """
    state = manifest(spark, path, version)
    if state["schema"] is None:
        raise ValueError(f"nothing has been saved in {path}")
    wanted = {"models": models, "services": services, "statuses": statuses}

    def may_hold(day: dict) -> bool:
        return all(names is None or day[kind] is None or set(names) & set(day[kind]) for kind, names in wanted.items())

    days = [d for d, x in state["days"].items() if (first is None or d >= first) and (last is None or d <= last) and may_hold(x)]
    rows = _days(spark, path, state, days)
    for edge, keep in ((first, F.col("date") >= F.to_date(F.lit(first))), (last, F.col("date") <= F.to_date(F.lit(last)))):
        rows = rows if edge is None else rows.where(keep)
    for kind, names in wanted.items():
        rows = rows if names is None else rows.where(F.col(LISTED[kind]).isin(*names))
    return rows


def _bucket():
    return F.pmod(F.xxhash64("task_id"), F.lit(BUCKETS)).cast("string")


def save_stats(df: DataFrame, path: str, number: str | None = None) -> int:
    """Upsert ``df`` (task_id, created_at and more) and return the version: the latest row of a task wins, old or new.

    Of rows of one time the one of the least ``number`` wins, a column of ``df`` that numbers rows as they came; the store keeps it.
    ``df`` may have several rows a task; rows without a task go, rows without ``created_at`` are taken to be of now.  Days that
    hold a task of ``df``, before or after, are written anew; all others stay as they are.
    """
    spark = df.sparkSession
    state = manifest(spark, path)
    commit = f"commit={state['version'] + 1}-{uuid.uuid4().hex}"
    latest_per_task(df, number).write.parquet(f"{path}/staged/{commit}")  # read several times, and ``now`` must not move
    new = spark.read.parquet(f"{path}/staged/{commit}")
    buckets = sorted(r[0] for r in new.select(_bucket()).distinct().collect())
    index = _read(spark, path, "index", StructField("bucket", StringType()), StructType.fromDDL("task_id string, date date"), [state["index"][b] for b in buckets if b in state["index"]])
    tasks = new.select("task_id")
    before = {str(r[0]) for r in index.join(tasks, "task_id", "left_semi").select("date").distinct().collect()}
    touched = sorted(before | {str(r[0]) for r in new.select("date").distinct().collect()})
    if not touched:
        return state["version"]
    merged = new.drop("date")
    if state["schema"] is not None:
        merged = merged.unionByName(_days(spark, path, state, [d for d in touched if d in state["days"]]).drop("date"), allowMissingColumns=True)
    merged = latest_per_task(merged, number)
    merged.write.partitionBy("date").parquet(f"{path}/data/{commit}")
    schema = StructType([f for f in merged.schema.fields if f.name != "date"])
    written = spark.read.schema(merged.schema).parquet(f"{path}/data/{commit}")
    names = [F.collect_set(c).alias(kind) if c in merged.columns else F.lit(None).cast("array<string>").alias(kind) for kind, c in LISTED.items()]
    about = written.groupBy("date").agg(F.count("*").alias("rows"), *names).collect()  # a row a day
    days = {d: x for d, x in state["days"].items() if d not in touched}
    for r in about:
        lists = {kind: None if r[kind] is None or len(r[kind]) > MOST_NAMES else sorted(r[kind]) for kind in LISTED}
        days[str(r.date)] = {"folder": f"data/{commit}/date={r.date}", "rows": r.rows, **lists}
    placed = written.join(tasks, "task_id", "left_semi").select("task_id", "date").withColumn("bucket", _bucket())
    kept = index.join(tasks, "task_id", "left_anti").select("task_id", "date", "bucket")
    kept.unionByName(placed).write.partitionBy("bucket").parquet(f"{path}/index/{commit}")
    index_now = state["index"] | {b: f"index/{commit}/bucket={b}" for b in buckets}
    _commit(spark, path, {"version": state["version"] + 1, "schema": schema.jsonValue(), "days": dict(sorted(days.items())), "index": index_now})
    staged, fs = _path(spark, f"{path}/staged/{commit}")
    fs.delete(staged, True)
    return state["version"] + 1


def vacuum(spark: SparkSession, path: str, keep: int = 2, min_age_s: int = 86_400) -> int:
    """Delete all but the last ``keep`` versions, and folders that none of those names, failed commits' too; returns how many folders went.

    Folders of commits younger than ``min_age_s`` stay, as their writer may still be at work; so should readers of old versions be done by then.
    """
    kept = versions(spark, path)[-max(1, keep) :]
    live: set[str] = set()
    for number in kept:
        state = manifest(spark, path, number)
        live |= {x["folder"] for x in state["days"].values()} | set(state["index"].values())
    for number in set(versions(spark, path)) - set(kept):  # before the folders that they name
        file, fs = _path(spark, f"{path}/manifest/{number:010d}.json")
        fs.delete(file, False)
    gone, oldest = 0, time.time() * 1000 - min_age_s * 1000
    for kind in ("data", "index", "staged"):
        root, fs = _path(spark, f"{path}/{kind}")
        for commit in fs.listStatus(root) if fs.exists(root) else []:
            if commit.getModificationTime() > oldest:
                continue
            name = commit.getPath().getName()
            parts = [x.getPath() for x in fs.listStatus(commit.getPath()) if x.isDirectory()]
            unused = [x for x in parts if f"{kind}/{name}/{x.getName()}" not in live]
            for folder in [commit.getPath()] if len(unused) == len(parts) else unused:
                gone += bool(fs.delete(folder, True))
    return gone
