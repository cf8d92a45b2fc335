"""The engine's input tables, derived from the given tables with integer arithmetic.

Each has a Spark form and a DuckDB form (the CTEs in ``CTES``) with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelake.functions.timedtext import words_in


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: shares of documents for each split of the files, so that a share has few enough words to sort
SHARES = 8


def dealt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt by their id: what is made of a document stays in its task, so windows by video move texts once, never words."""
    docs = table(spark, sf_dir, "documents")
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), SHARES * docs.rdd.getNumPartitions())
    return docs.repartition(shares, "doc_id")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, pos, s_ms, e_ms, w) from the words of documents."""
    w = dealt_documents(spark, sf_dir).select(F.col("doc_id").alias("video_id"), F.posexplode(words_in(F.col("text"))).alias("pos", "w"))
    dur = F.when(F.pmod(F.col("video_id") + F.col("pos"), F.lit(13)) == 0, 20).otherwise(40 * F.length("w"))
    gap = F.when(F.pmod(F.col("video_id") + 3 * F.col("pos"), F.lit(11)) == 0, 900).otherwise(40 * F.pmod("pos", F.lit(5)))
    before = Window.partitionBy("video_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    timed = w.withColumn("dur", dur).withColumn("gap", gap).withColumn("s_ms", F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(before), F.lit(0)))
    return timed.select("video_id", "pos", "s_ms", (F.col("s_ms") + F.col("dur")).alias("e_ms"), "w")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, said): the words of a document as one array, dealt as they are."""
    return dealt_documents(spark, sf_dir).select(F.col("doc_id").alias("video_id"), words_in(F.col("text")).alias("said"))


def distinct_ids(spark: SparkSession, sf_dir: str) -> bool:
    """Whether each document has an id that no other has; one job over the ids, of which the driver gets the answer."""
    ids = table(spark, sf_dir, "documents").groupBy("doc_id").count()
    return ids.where("doc_id is null or count > 1").isEmpty()


def segments(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """(video_id, pos, start_ms, end_ms, text): the non-blank lines of documents, one every 3 s; ``dealt`` by video for what looks at whole videos."""
    docs = dealt_documents(spark, sf_dir) if dealt else table(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.where(F.trim("text") != "").select("video_id", "pos", (F.col("pos") * 3000).cast("bigint").alias("start_ms"), (F.col("pos") * 3000 + 20 * F.length("text")).cast("bigint").alias("end_ms"), "text")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as numbered cues with a translation that is upper case, shortened or blank by position, and some cues repeated."""
    s = segments(spark, sf_dir, dealt=True)
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("pos"))
    numbered = s.withColumn("cue_id", number)
    first = F.first("text").over(Window.partitionBy("video_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    text = F.when(F.pmod("cue_id", F.lit(9)) == 2, first).otherwise(F.col("text"))
    translated = F.when(F.pmod("cue_id", F.lit(7)) == 3, "").when(F.pmod("cue_id", F.lit(5)) == 1, F.substring("text", 1, 30)).otherwise(F.upper(F.replace("text", F.lit("ß"), F.lit("s"))))
    end = F.when(F.pmod("cue_id", F.lit(6)) == 4, F.col("start_ms") + F.floor(1000 * F.length("text") / 95)).when(F.pmod("cue_id", F.lit(6)) == 5, F.col("start_ms") + F.floor(1000 * F.length("text") / 50)).otherwise(F.col("end_ms"))
    return numbered.select("video_id", "cue_id", "start_ms", end.cast("bigint").alias("end_ms"), text.alias("text"), translated.alias("translated_text"), F.pmod("cue_id", F.lit(4)).cast("int").alias("degenerate_run"), (F.pmod(F.col("video_id") + F.col("cue_id"), F.lit(17)) == 0).alias("context_only"))


SIZES = [(1280, 720), (1920, 1080), (3840, 2160), (854, 480), (640, 360), (1920, 800), (720, 1280)]


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, width, height, duration_ms, source_lang, target_lang) from documents."""
    pick = F.element_at(F.array(*(F.struct(F.lit(w).alias("width"), F.lit(h).alias("height")) for w, h in SIZES)), (F.pmod("doc_id", F.lit(len(SIZES))) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("video_id"), pick["width"].alias("width"), pick["height"].alias("height"), (200 * F.col("n_chars")).cast("bigint").alias("duration_ms"), F.col("lang").alias("source_lang"), F.when(F.pmod("doc_id", F.lit(2)) == 0, "he").otherwise("en").alias("target_lang"))


def energy_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, w_start_ms, w_end_ms, db): events dealt over documents as loudness windows of 4 s."""
    e = table(spark, sf_dir, "events")
    start = F.pmod(F.col("event_id") * 7, F.lit(60)) * 1000
    return e.select(F.col("user_id").alias("video_id"), start.alias("w_start_ms"), (start + 4000).alias("w_end_ms"), (-F.floor("value") / 10).alias("db"))


def job_stats(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    """Job statistics from events: one row an event, some tasks written twice; ``numbered`` with event_id."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        *["event_id"] * numbered,
        F.shiftright("event_id", 1).cast("string").alias("task_id"),
        F.col("ts").alias("created_at"),
        F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "view", "running").otherwise("success").alias("status"),
        F.element_at(F.array(F.lit("tiny"), F.lit("base"), F.lit(None)), (F.pmod("user_id", F.lit(3)) + 1).cast("int")).alias("transcription_model"),
        F.when(F.pmod("event_id", F.lit(2)) == 0, "alpha").otherwise("beta").alias("translation_service"),
        F.col("value").alias("total_duration"),
        (F.col("value") * 4).alias("video_duration"),
        (F.pmod("event_id", F.lit(40)) / 10).alias("transcription_speed_ratio"),
        (10 * k).alias("translation_tokens"),
        (k / 1000).alias("translation_cost_usd"),
        F.when(F.pmod("event_id", F.lit(4)) != 0, F.pmod("event_id", F.lit(9)).cast("int")).alias("cps_over_budget"),
    )


def run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived runs from orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("video"), F.col("o_orderstatus").alias("pipeline"), F.col("o_orderdate").alias("run_at"), F.col("o_totalprice").alias("cost_usd"), F.pmod("o_orderkey", F.lit(50)).cast("int").alias("cues"), F.when(F.pmod("o_orderkey", F.lit(5)) != 0, F.pmod("o_orderkey", F.lit(4)).cast("int")).alias("over_budget"))


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress, usage and transfer events from events: (task_id, ts, step_index, progress, tokens, status)."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select("event_id", F.col("user_id").alias("task_id"), "ts", F.pmod("event_id", F.lit(7)).cast("int").alias("step_index"), (k * 3 - 20).alias("progress"), (10 * k).alias("tokens"), F.col("event_type").alias("message"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a translation service to chunks of ten cues, as JSON: some ids missing, some foreign, some fenced, some broken."""
    c = cues(spark, sf_dir).withColumn("chunk", F.floor((F.col("cue_id") - 1) / 10).cast("int"))
    extra = F.when(F.pmod("cue_id", F.lit(11)) == 5, F.array(F.named_struct(F.lit("id"), (F.col("cue_id") + 5000).cast("string"), F.lit("t"), F.lit("extra")))).otherwise(F.array().cast("array<struct<id:string,t:string>>"))
    items = F.when(F.pmod("cue_id", F.lit(7)) == 0, extra).otherwise(F.concat(F.array(F.named_struct(F.lit("id"), F.col("cue_id").cast("string"), F.lit("t"), F.upper(F.replace("text", F.lit("ß"), F.lit("s"))))), extra))
    body = F.to_json(F.named_struct(F.lit("cues"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("cue_id", items.alias("items")))), lambda x: x["items"]))))
    grouped = c.groupBy("video_id", "chunk").agg(body.alias("body"))
    content = F.when(F.pmod(F.col("video_id") + F.col("chunk"), F.lit(10)) == 3, F.concat(F.lit("```json\n"), "body", F.lit("\n```"))).when(F.pmod(F.col("video_id") + F.col("chunk"), F.lit(10)) == 4, F.substring("body", 1, 15)).otherwise(F.col("body"))
    return grouped.select("video_id", "chunk", content.alias("content"))


#: name -> (needs, SQL)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "words": ((), r"""
      select video_id, pos, s_ms, s_ms + dur as e_ms, w from (
        select *, cast(coalesce(sum(dur + gap) over (partition by video_id order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as s_ms from (
          select *, case when (video_id + pos) % 13 = 0 then 20 else 40 * length(w) end as dur,
                 case when (video_id + 3 * pos) % 11 = 0 then 900 else 40 * (pos % 5) end as gap from (
            select doc_id as video_id, unnest(t) as w, cast(generate_subscripts(t, 1) - 1 as integer) as pos
            from (select doc_id, string_split(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), ' ') as t from documents))))"""),
    "segments": ((), r"""
      select video_id, pos, cast(pos * 3000 as bigint) as start_ms, cast(pos * 3000 + 20 * length(text) as bigint) as end_ms, text from (
        select doc_id as video_id, unnest(t) as text, cast(generate_subscripts(t, 1) - 1 as integer) as pos
        from (select doc_id, string_split(text, chr(10)) as t from documents)) where trim(text) <> ''"""),
    "cues": (("segments",), r"""
      select video_id, cue_id, start_ms,
             cast(case when cue_id % 6 = 4 then start_ms + floor(1000 * length(text) / 95) when cue_id % 6 = 5 then start_ms + floor(1000 * length(text) / 50) else end_ms end as bigint) as end_ms,
             case when cue_id % 9 = 2 then f else text end as text,
             case when cue_id % 7 = 3 then '' when cue_id % 5 = 1 then substr(text, 1, 30) else upper(replace(text, 'ß', 's')) end as translated_text,
             cast(cue_id % 4 as integer) as degenerate_run, (video_id + cue_id) % 17 = 0 as context_only
      from (select *, cast(row_number() over (partition by video_id order by pos) as integer) as cue_id,
                   first_value(text) over (partition by video_id order by pos) as f from segments)"""),
    "videos": ((), """
      select doc_id as video_id, [1280, 1920, 3840, 854, 640, 1920, 720][doc_id % 7 + 1] as width, [720, 1080, 2160, 480, 360, 800, 1280][doc_id % 7 + 1] as height,
             200 * n_chars as duration_ms, lang as source_lang, case when doc_id % 2 = 0 then 'he' else 'en' end as target_lang from documents"""),
    "energy_windows": ((), """
      select user_id as video_id, event_id * 7 % 60 * 1000 as w_start_ms, event_id * 7 % 60 * 1000 + 4000 as w_end_ms, -floor(value) / 10 as db from events"""),
    "job_stats": ((), """
      select cast(event_id // 2 as varchar) as task_id, ts as created_at,
             case when event_type = 'error' then 'failure' when event_type = 'view' then 'running' else 'success' end as status,
             ['tiny', 'base', null][user_id % 3 + 1] as transcription_model, case when event_id % 2 = 0 then 'alpha' else 'beta' end as translation_service,
             value as total_duration, value * 4 as video_duration, event_id % 40 / 10.0::double as transcription_speed_ratio,
             10 * k as translation_tokens, k / 1000.0::double as translation_cost_usd,
             case when event_id % 4 <> 0 then cast(event_id % 9 as integer) end as cps_over_budget
      from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)"""),
    "run_index": ((), """
      select o_orderkey as task_id, o_custkey as video, o_orderstatus as pipeline, o_orderdate as run_at, o_totalprice as cost_usd, cast(o_orderkey % 50 as integer) as cues,
             case when o_orderkey % 5 <> 0 then cast(o_orderkey % 4 as integer) end as over_budget from orders"""),
    "progress_events": ((), """
      select event_id, user_id as task_id, ts, cast(event_id % 7 as integer) as step_index, k * 3 - 20 as progress, 10 * k as tokens, event_type as message
      from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)"""),
}


def with_ctes(names: str, sql: str) -> str:
    """``sql`` with the named derived tables in front."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in done:
            for n in CTES[name][0]:
                add(n)
            done[name] = f"{name} as ({CTES[name][1]})"

    for n in names.split():
        add(n)
    rest = sql.strip()
    recursive = "recursive " if rest.lower().startswith("with recursive") else ""
    if rest.lower().startswith("with "):
        rest = rest[len("with recursive ") if recursive else len("with ") :]
        return f"with {recursive}{', '.join(done.values())}, {rest}"
    return f"with {', '.join(done.values())} {rest}"
