"""Replies of a translation service: parsing, matching by id, work lists, fallbacks, stage differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ITEM = "array<struct<id:string,t:string,text:string,translation:string>>"


def parse_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, rejects): ids and texts of JSON replies, with or without a code fence; text under t, text or translation.

    Ids may be strings; those that aren't whole numbers and blank texts are left out.  Rejects are replies that aren't JSON.
    """
    body = F.trim(F.regexp_replace(F.regexp_replace("content", r"^\s*```\w*\s*", ""), r"\s*```\s*$", ""))
    df = replies.withColumn("__body", body).withColumn("__ok", F.try_parse_json(body).isNotNull())
    parsed = F.coalesce(F.from_json("__body", f"cues {ITEM}")["cues"], F.from_json("__body", f"translations {ITEM}")["translations"], F.from_json("__body", ITEM))
    keys = [c for c in replies.columns if c != "content"]
    items = df.where("__ok").select(*keys, F.posexplode(parsed).alias("ord", "x"))
    text = F.coalesce(*(F.nullif(F.trim(F.col(f"x.{n}")), F.lit("")) for n in ("t", "text", "translation")))
    out = items.select(*keys, "ord", F.col("x.id").try_cast("int").alias("id"), text.alias("text")).where("id is not null and text is not null")
    return out, df.where("not __ok").select(replies.columns)


def merge_replies_by_id(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Requested ids against replied ones, per (video_id, chunk): status ok, missing or extra; the last of repeated ids wins."""
    last = items.groupBy("video_id", "chunk", "id").agg(F.max_by("text", "ord").alias("reply"))
    both = requests.select("video_id", "chunk", "id", F.lit(True).alias("__asked")).join(last, ["video_id", "chunk", "id"], "full")
    status = F.when(F.col("__asked").isNull(), "extra").when(F.col("reply").isNull(), "missing").otherwise("ok")
    return both.select("video_id", "chunk", "id", status.alias("status"), F.when(F.col("__asked"), F.col("reply")).alias("reply"))


def missing_reply_worklist(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Per chunk with unanswered ids: those ids, and the answered rest as context."""
    keys = ["video_id", "chunk", "id"]
    found = items.select(*keys).distinct()
    gone = requests.join(found, keys, "left_anti").groupBy("video_id", "chunk").agg(F.array_sort(F.collect_list("id")).alias("missing_ids"))
    rest = requests.join(found, keys, "left_semi").groupBy("video_id", "chunk").agg(F.array_sort(F.collect_list("id")).alias("context_ids"))
    return gone.join(rest, ["video_id", "chunk"], "left").withColumn("context_ids", F.coalesce("context_ids", F.array().cast("array<int>")))


def fill_or_fail(requests: DataFrame, items: DataFrame, strict: bool = False) -> DataFrame:
    """Every requested id with its reply, else its source text; ``strict`` raises instead and names all unanswered ids of a chunk."""
    keys = ["video_id", "chunk", "id"]
    last = items.groupBy(*keys).agg(F.max_by("text", "ord").alias("reply"))
    df = requests.join(last, keys, "left").withColumn("filled", F.col("reply").isNull())
    if strict:
        gone = df.where("filled").groupBy("video_id", "chunk").agg(F.array_sort(F.collect_list("id")).alias("__gone"))
        df = df.join(gone, ["video_id", "chunk"], "left")
        told = F.concat(F.lit("no reply to ids "), F.array_join(F.col("__gone").cast("array<string>"), ", "), F.lit(" of video "), F.col("video_id").cast("string"), F.lit(", chunk "), F.col("chunk").cast("string"))
        return df.withColumn("reply", F.when(F.col("filled"), F.raise_error(told).cast("string")).otherwise(F.col("reply"))).drop("__gone")
    return df.withColumn("reply", F.coalesce("reply", "text"))


def fill_by_position(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Requests (video_id, chunk, id, text) with the replies of a service that answers by position: (video_id, chunk, texts array).

    Replies in excess are trimmed, a shortage is padded with source texts, a chunk without a reply keeps them all.  ``excess`` and
    ``shortage`` tell by how many the chunk's reply was off.
    """
    chunk = Window.partitionBy("video_id", "chunk")
    numbered = requests.withColumn("__at", F.row_number().over(chunk.orderBy("id")) - 1).withColumn("__n", F.count("*").over(chunk))
    df = numbered.join(replies.select("video_id", "chunk", F.col("texts").alias("__texts")), ["video_id", "chunk"], "left")
    got = F.when(F.col("__texts").isNull(), 0).otherwise(F.size("__texts"))
    reply = F.get(F.col("__texts"), F.col("__at"))
    out = df.withColumn("filled", F.col("__at") >= got).withColumn("excess", F.greatest(F.lit(0), got - F.col("__n")).cast("bigint")).withColumn("shortage", F.greatest(F.lit(0), F.col("__n") - got).cast("bigint"))
    return out.withColumn("reply", F.when(F.col("filled"), F.col("text")).otherwise(reply)).drop("__at", "__n", "__texts")


def id_differences(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of (video_id, chunk, id) in one set only, as side missing or extra."""
    cols = ["video_id", "chunk", "id"]
    a, b = expected.select(cols), found.select(cols)
    return a.subtract(b).withColumn("side", F.lit("missing")).unionByName(b.subtract(a).withColumn("side", F.lit("extra")))


def correction_rate(cues: DataFrame) -> DataFrame:
    """Per video: cues asked, unchanged but for white space, and corrected."""
    same = F.trim(F.regexp_replace("text", r"\s+", " ")) == F.trim(F.regexp_replace("translated_text", r"\s+", " "))
    asked = cues.where("trim(text) <> '' and trim(translated_text) <> ''")
    return asked.groupBy("video_id").agg(F.count("*").alias("asked"), F.count_if(same).alias("unchanged"), F.count_if(~same).alias("corrected"))


def stage_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str = "text") -> DataFrame:
    """Keys added, removed or changed between two archived stages."""
    both = before.select(*keys, F.col(value).alias("__a")).join(after.select(*keys, F.col(value).alias("__b")), keys, "full")
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("__a").eqNullSafe(F.col("__b"))).select(*keys, change.alias("change"))
