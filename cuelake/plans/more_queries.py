"""Queries of reflow, batching, choice, media, archive and caller-supplied functions, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cuelake.operators import batches, media, reflow
from cuelake.plans import bindings as B
from cuelake.plans import spot_sql
from cuelake.plans.bindings import with_ctes
from cuelake.sources import archive, tracks
from cuelake.sources.streams import shared_folder

QUERIES, ORACLES = {}, {}


def query(name: str, ctes: str = "", sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_ctes(ctes, sql) if ctes else sql
        return f

    return add


def folder(spark) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


DANGLING = "select video_id, cue_id, start_ms, end_ms, case when cue_id % 3 = 1 then text || ' ' || ['ו', 'ב-', 'x'][video_id % 3 + 1] else text end as text from cues"


@query("w12_reflow_connectors", "cues", f"""
with d as ({DANGLING}), n as (
  select *, rtrim(text) as t, ltrim(lead(text) over o) as nx, lead(start_ms) over o - end_ms as gap, regexp_extract(rtrim(text), '\\s([ושהבלכמ]-?)$', 1) as tok from d window o as (partition by video_id order by start_ms, cue_id)
), m as (
  select *, rtrim(substr(t, 1, length(t) - length(tok))) as rest, tok || case when tok not like '%-' and regexp_matches(nx, '^[\\p{{Latin}}0-9]') then '-' else '' end as full_ from n
), v as (select *, coalesce(tok <> '' and nx <> '' and gap <= 1500 and rest <> '' and length(full_ || nx) <= 84, false) as moved from m),
g as (select *, lag(case when moved then full_ end) over (partition by video_id order by start_ms, cue_id) as got, case when moved then rest else text end as own from v)
select video_id, cue_id, case when got is not null then got || ltrim(own) else own end as text, moved from g""")
def w12(spark, sf):
    pick = F.element_at(F.array(F.lit("ו"), F.lit("ב-"), F.lit("x")), (F.col("video_id") % 3 + 1).cast("int"))
    c = B.cues(spark, sf).withColumn("text", F.when(F.col("cue_id") % 3 == 1, F.concat("text", F.lit(" "), pick)).otherwise(F.col("text")))
    return reflow.reflow_connectors(c).select("video_id", "cue_id", "text", "moved")


def halved(first: str, limit: int, passes: int) -> str:
    steps = [f"h0 as (select *, {first} as path from t)"]
    for k in range(passes):
        steps.append(f"""s{k} as (select *, count(*) over w as n, sum(tokens) over w as s, row_number() over (partition by video_id, path order by pos) - 1 as i from h{k} window w as (partition by video_id, path)),
        h{k + 1} as (select video_id, pos, tokens, path || case when n > 1 and s > {limit} then case when i < n // 2 then 'a' else 'b' end else '' end as path from s{k})""")
    return f"""with t as (select video_id, pos, len(regexp_extract_all(text, '\\S+')) * 13 // 10 as tokens from segments), {', '.join(steps)},
    o as (select *, coalesce(lag(path) over (partition by video_id order by pos) <> path, true) as opens from h{passes})
    select video_id, pos, tokens, cast(sum(cast(opens as int)) over (partition by video_id order by pos rows unbounded preceding) - 1 as bigint) as batch, tokens > {limit} as oversize from o"""


@query("w17_batch_by_count", "segments", halved("cast((row_number() over (partition by video_id order by pos) - 1) // 20 as varchar)", 300, 5))
def w17(spark, sf):
    return reflow.batch_by_count(B.segments(spark, sf, dealt=True), 20, 300).select("video_id", "pos", "tokens", "batch", "oversize")


@query("w18_batch_by_tokens", "segments", halved("'r'", 400, 14))
def w18(spark, sf):
    return reflow.batch_by_tokens(B.segments(spark, sf, dealt=True), 400).select("video_id", "pos", "tokens", "batch", "oversize")


@query("k04_choose_candidate", "segments", """
with c as (select video_id, pos, trim(text) as original, length(trim(text)) * 8 // 10 as lim, [trim(substr(text, 1, 20)), trim(substr(text, 1, 35)), trim(substr(text, 3, 35)), trim(substr(text, 1, 80))] as texts, [pos % 4 <> 1, pos % 3 <> 1, true, pos % 2 = 0] as legal from segments),
l as (select *, list_filter(texts, lambda x, i: legal[i] and x <> '') as ok from c),
f as (select *, list_filter(ok, lambda x: length(x) <= lim) as fit, list_append(ok, original) as usable from l)
select video_id, pos, case when len(fit) > 0 then list_filter(fit, lambda x: length(x) = list_max(list_transform(fit, lambda y: length(y))))[1] else list_filter(usable, lambda x: length(x) = list_min(list_transform(usable, lambda y: length(y))))[1] end as choice,
       coalesce(list_max(list_transform(fit, lambda y: length(y))), list_min(list_transform(usable, lambda y: length(y)))) <= lim as fits from f""")
def k04(spark, sf):
    cut = lambda a, n: F.trim(F.substring("text", a, n))
    options = F.array(*(F.struct(t.alias("text"), ok.alias("legal")) for t, ok in ((cut(1, 20), F.col("pos") % 4 != 1), (cut(1, 35), F.col("pos") % 3 != 1), (cut(3, 35), F.lit(True)), (cut(1, 80), F.col("pos") % 2 == 0))))
    c = B.segments(spark, sf).select("video_id", "pos", F.trim("text").alias("original"), F.floor(F.length(F.trim("text")) * 8 / 10).alias("limit"), options.alias("candidates"))
    return reflow.choose_candidate(c).select("video_id", "pos", "choice", "fits")


def listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


STRIPPED = reflow.STRIPPED.replace("'", "''").replace("\t", "' || chr(9) || '").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '")
COMPARED = f"list_filter(list_transform(regexp_split_to_array(trim(@text), '\\s+'), lambda w: lower(regexp_replace(trim(w, '{STRIPPED}'), '[\\x{{0591}}-\\x{{05c7}}]', '', 'g'))), lambda w: w <> '')"
HAS = "(list_contains({0}, {1}) or list_contains({0}, 'ו' || {1}) or ({1} like 'ו%' and list_contains({0}, substr({1}, 2))))"
ENDINGS = ["הם נחשבים קשוחים.", "לא הכינו את עצמכם?", "3 apples or 12%.", "he said: never!", "and then…", "it was the"]
SHORTENED = ["והם נחשבים מאוד.", "הכינו את עצמכם?", "apples or 12%.", "he said: no!", "and then.", "it was the"]


@query("k05_condensation_check", "segments", f"""
with c as (select video_id, pos, text || ' ' || [{listed(ENDINGS)}][pos % 6 + 1] as a, text || ' ' || [{listed(SHORTENED)}][pos % 6 + 1] as b from segments),
d as (select video_id, pos, case when pos % 8 = 7 then '— ' || a else a end as a, case when pos % 8 = 0 then ' ' when pos % 8 = 1 then '...' when pos % 8 = 2 then a when pos % 8 = 3 then regexp_replace(a, '^\\S+\\s+', '') when pos % 8 = 4 then regexp_replace(a, '\\s+\\S+$', '') else b end as b from c),
t as (select video_id, pos, trim(a) as o, trim(b) as c, {COMPARED.replace("@text", "a")} as x, {COMPARED.replace("@text", "b")} as y, right(trim(a), 1) as e, right(trim(b), 1) as f from d),
w as (select *, list_filter(x, lambda w: w not in ({listed(reflow.MAY_GO)}))[-1] as content, list_filter(x, lambda w: (w in ({listed(reflow.MUST_STAY)}) or regexp_matches(w, '\\p{{Nd}}')) and not {HAS.format("y", "w")}) as lost from t)
select video_id, pos, case when c = '' then 'empty' when len(y) = 0 then 'no_words' when starts_with(o, '— ') and not starts_with(c, '— ') then 'lost_dash'
  when e in ('.', '?', '!', '…') and f <> e and not (e = '…' and f in ('.', '?', '!', '…')) then 'changed_mark' when e in ('.', '?', '!', '…', ',', ':', ';') and f not in ('.', '?', '!', '…', ',', ':', ';') then 'lost_mark'
  when content is not null and not {HAS.format("y", "content")} then 'lost_content' when len(lost) > 0 then case when regexp_matches(lost[1], '\\p{{Nd}}') then 'lost_number' else 'lost_negation' end
  when y[-1] in ({listed(reflow.WEAK_ENDS)}) then 'weak_end' end as reason from w""")
def k05(spark, sf):
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("pos") % 6 + 1).cast("int"))
    a, b, k = F.concat("text", F.lit(" "), pick(ENDINGS)), F.concat("text", F.lit(" "), pick(SHORTENED)), F.col("pos") % 8
    shorter = F.when(k == 0, " ").when(k == 1, "...").when(k == 2, a).when(k == 3, F.regexp_replace(a, r"^\S+\s+", "")).when(k == 4, F.regexp_replace(a, r"\s+\S+$", "")).otherwise(b)
    c = B.segments(spark, sf).select("video_id", "pos", F.when(k == 7, F.concat(F.lit("— "), a)).otherwise(a).alias("original"), shorter.alias("candidate"))
    return reflow.condensation_check(c).select("video_id", "pos", "reason")


@query("w19_transfer_speed", "", """
with recursive q as (
  select user_id as task_id, event_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as i, cast(floor(value * 100) as bigint) as bytes from events
), f as (
  select task_id, event_id, i, t as last_t, bytes as last_b, cast(null as double) as ema, false as hit from q where i = 1
  union all
  select q.task_id, q.event_id, q.i, case when q.t - last_t < 2000000 or bytes <= last_b then last_t else q.t end, case when q.t - last_t < 2000000 or bytes <= last_b then last_b else bytes end,
         case when q.t - last_t < 2000000 or bytes <= last_b then ema when ema is null then (bytes - last_b) * 1e6::double / (q.t - last_t) else 0.3::double * ((bytes - last_b) * 1e6::double / (q.t - last_t)) + 0.7::double * ema end, not (q.t - last_t < 2000000 or bytes <= last_b)
  from f join q on q.task_id = f.task_id and q.i = f.i + 1
)
select task_id, event_id, round(ema, 9) as speed from f where hit""")
def w19(spark, sf):
    e = B.table(spark, sf, "events").select(F.col("user_id").alias("task_id"), "event_id", "ts", F.floor(F.col("value") * 100).cast("bigint").alias("bytes"))
    return reflow.transfer_speed(e).withColumn("speed", F.round("speed", 9))


def band_rows(spark, sf):
    px = F.transform("embedding", lambda x: F.round(x.cast("double") * 255).cast("int"))
    return B.table(spark, sf, "embeddings").select((F.floor(F.col("vec_id") / 50)).alias("video_id"), F.floor(F.col("vec_id") % 50 / 5).cast("int").alias("sample"), F.when(F.col("vec_id") % 100 < 50, "top").otherwise("low").alias("band"), (F.col("vec_id") % 5).cast("int").alias("row"), px.alias("px"))


BANDS = """bands as (
  select vec_id // 50 as video_id, cast(vec_id % 50 // 5 as integer) as sample, case when vec_id % 100 < 50 then 'top' else 'low' end as band, vec_id % 5 as row_, list_transform(embedding, lambda x: cast(round(cast(x as double) * 255) as integer)) as px from embeddings
), e as (
  select *, lead(px) over (partition by video_id, sample, band order by row_) as below from bands
), d as (
  select video_id, sample, band, len(list_filter(range(1, len(px)), lambda i: abs(px[i] - px[i + 1]) > 24)) + case when below is null then 0 else len(list_filter(range(1, len(px) + 1), lambda i: abs(px[i] - below[i]) > 24)) end as jumps, len(px) - 1 + case when below is null then 0 else len(px) end as pairs from e
), scores as (select video_id, sample, band, sum(jumps) / cast(sum(pairs) as double) as score from d group by all)"""


@query("p21_edge_density", "", f"with {BANDS} select * from scores")
def p21(spark, sf):
    return media.edge_density(band_rows(spark, sf))


@query("a08_band_verdict", "", f"""
with {BANDS}, v as (select video_id, band, count(score) as samples, quantile_cont(score, 0.75) as p, count(*) filter (score > 0.07) as busy_samples from scores group by all)
select video_id, band, samples, round(p, 4) as score, busy_samples, case when samples >= 3 then round(p, 4) > 0.07 or busy_samples >= 2 end as busy from v""")
def a08(spark, sf):
    return media.band_verdict(media.edge_density(band_rows(spark, sf)))


def resolved(spark, sf):
    links = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)
    entries = F.transform(links, lambda x, i: F.when(i % 4 != 3, F.struct(x.alias("url"), F.when(i % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("v"), x)).alias("title"), (F.length(x) * 7 + i).cast("bigint").alias("duration"))))
    return media.resolve_candidates(B.table(spark, sf, "pages").select("page_id", entries.alias("entries")))


PAGES = """links as (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as l from pages), items as (
  select page_id, unnest(l) as u, generate_subscripts(l, 1) - 1 as i from links), ok as (
  select page_id, u, i, length(u) * 7 + i as duration, case when i % 2 = 0 then 'Untitled' else 'v' || u end as title from items where i % 4 <> 3), res as (
  select p.page_id, count(o.u) as n, max(duration) as longest, list(u order by -duration, u, title) filter (u is not null) as urls from pages p left join ok o using (page_id) group by 1)"""


@query("p22_resolve_candidates", "", f"with {PAGES} select page_id, case when n = 0 then 'none' when n = 1 then 'single' else 'multiple' end as type, coalesce(array_to_string(urls, ' '), '') as urls from res")
def p22(spark, sf):
    return resolved(spark, sf).select("page_id", "type", F.array_join(F.transform("videos", lambda v: v["url"]), " ").alias("urls"))


@query("k03_longest_first", "", f"with {PAGES} select page_id, u as url, duration, cast(row_number() over (partition by page_id order by duration desc, u) as integer) as rank from ok qualify rank <= 3")
def k03(spark, sf):
    from pyspark.sql.window import Window

    v = resolved(spark, sf).select("page_id", F.explode("videos").alias("v")).select("page_id", "v.url", "v.duration")
    return v.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("duration"), "url"))).where("rank <= 3")


@query("a19_probe_summary", "", f"with {PAGES} select count(*) filter (n = 0) as none, count(*) filter (n = 1) as single, count(*) filter (n > 1) as multiple, max(longest) as longest from res")
def a19(spark, sf):
    return media.probe_summary(resolved(spark, sf))


@query("p18_performance_flags", "", """
with f as (select event_id, event_id % 50 / 10.0::double as dl, event_id % 30 / 20.0::double as rtf, event_id % 7 as rr, event_id % 11 as mv, event_id % 13 / 100.0::double as cost from events)
select event_id, array_to_string(list_filter([case when dl < 0.5 then 'download_critical' when dl < 2 then 'download_slow' end, case when rtf > 1 then 'slower_than_real_time' end, case when rr < 2 then 'render_slow' end, case when mv > 5 then 'move_slow' end,
  case when cost >= 0.1 then 'cost_warning' when cost >= 0.01 then 'cost_info' end, case when event_id % 101 > 85 then 'memory_high' end, case when event_id % 97 > 90 then 'disk_high' end], lambda x: x is not null), ',') as flags from f""")
def p18(spark, sf):
    e = F.col("event_id")
    f = B.table(spark, sf, "events").select("event_id", (e % 50 / 10).alias("download_mb_s"), (e % 30 / 20).alias("rtf"), (e % 7).alias("render_ratio"), (e % 11).alias("move_s"), (e % 13 / 100).alias("cost_usd"), (e % 101).alias("memory_percent"), (e % 97).alias("disk_percent"))
    return media.performance_flags(f).select("event_id", F.array_join("flags", ",").alias("flags"))


@query("p19_quality_buckets", "", """
with f as (select p_partkey, [[p_size * 40, p_partkey % 3], [p_partkey % 1500, 1], [p_size * 25, p_partkey % 2]] as l from part), q as (
select p_partkey, list_transform(list_filter(l, lambda x: x[2] <> 0 and x[1] > 0), lambda x: case when x[1] >= 1080 then '1080p' when x[1] >= 720 then '720p' when x[1] >= 480 then '480p' else '360p' end) as q from f)
select p_partkey, array_to_string(list_reverse_sort(list_distinct(q)), ',') as qualities from q""")
def p19(spark, sf):
    codec = lambda n: F.when(F.col("p_partkey") % n == 0, "none").otherwise("h264")
    fmt = lambda v, h: F.struct(v.alias("vcodec"), h.cast("int").alias("height"))
    p = B.table(spark, sf, "part").select("p_partkey", F.array(fmt(codec(3), F.col("p_size") * 40), fmt(F.lit("h264"), F.col("p_partkey") % 1500), fmt(codec(2), F.col("p_size") * 25)).alias("formats"))
    return media.quality_buckets(p).select("p_partkey", F.array_join("qualities", ",").alias("qualities"))


@query("p10_normalize_glossary", "", """
select p_partkey, case when p_partkey % 5 = 0 then '' when p_partkey % 5 = 1 then 'b=' || p_size else 'a=' || trim(p_name) || ',b=' || p_size end as terms from part""")
def p10(spark, sf):
    k = F.col("p_partkey") % 5
    js = F.when(k == 0, "not json").otherwise(F.to_json(F.create_map(F.lit(" a "), F.when(k == 1, "  ").otherwise(F.concat("p_name", F.lit(" "))), F.lit("b"), F.col("p_size").cast("string"))))
    p = B.table(spark, sf, "part").select("p_partkey", js.alias("glossary"))
    return media.normalize_glossary(p).select("p_partkey", F.array_join(F.transform(F.map_entries("terms"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("terms"))


@query("p02_normalize_cues", "cues", """
with r as (select video_id, cue_id, case when cue_id % 13 = 5 then ' ' else text end as text, case when cue_id % 3 = 0 then null else translated_text end as t1, case when cue_id % 13 = 5 then null else lower(text) end as t2, case when cue_id % 8 = 2 then 'x' else cast(start_ms / 1000.0::double as varchar) end as s, start_ms from cues)
select video_id, cue_id, text, coalesce(nullif(trim(t1), ''), nullif(trim(t2), ''), '') as translated_text, coalesce(try_cast(s as double), 0) as start from r where trim(text) <> '' or coalesce(nullif(trim(t1), ''), nullif(trim(t2), ''), '') <> ''""")
def p02(spark, sf):
    k = F.col("cue_id")
    raw = B.cues(spark, sf).select("video_id", "cue_id", F.when(k % 13 == 5, " ").otherwise(F.col("text")).alias("text"), F.when(k % 3 != 0, F.col("translated_text")).alias("translated_text"), F.when(k % 13 != 5, F.lower("text")).alias("translated"), F.when(k % 8 == 2, "x").otherwise((F.col("start_ms") / 1000).cast("string")).alias("start"), (F.col("end_ms") / 1000).cast("string").alias("end"))
    return media.normalize_cues(raw).drop("end")


@query("s01_read_stats_jsonl", "job_stats", "select task_id, created_at, total_duration, translation_tokens from job_stats")
def s01(spark, sf):
    path = folder(spark)
    stats = B.job_stats(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp")).drop("transcription_speed_ratio")
    archive.append_stats(stats, path)
    spark.createDataFrame([("{broken",), ("",)], "value string").write.mode("append").text(path)
    rows, _ = archive.read_stats_jsonl(spark, path)
    return rows.select("task_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "total_duration", "translation_tokens")


@query("s02_append_stats", "job_stats", "select 2 * count(*) as n, 2 * count(*) as stamped from job_stats")
def s02(spark, sf):
    path = folder(spark)
    for _ in range(2):
        archive.append_stats(B.job_stats(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp")).drop("transcription_speed_ratio"), path)
    return archive.read_stats_jsonl(spark, path)[0].agg(F.count("*").alias("n"), F.count("timestamp").alias("stamped"))


@query("s04_stats_inventory", "job_stats", "select count(*) as entries from job_stats")
def s04(spark, sf):
    path = folder(spark)
    archive.append_stats(B.job_stats(spark, sf).drop("transcription_speed_ratio"), path)
    return archive.stats_inventory(spark, path).agg(F.sum("entries").alias("entries"))


@query("s05_export_csv", "job_stats", "select task_id, status, total_duration from job_stats")
def s05(spark, sf):
    path = folder(spark)
    archive.export_csv(B.job_stats(spark, sf).select("task_id", "status", "total_duration", F.array("status").alias("tags")), path)
    return spark.read.schema("task_id string, status string, total_duration double, tags string").option("header", True).csv(path).drop("tags")


@query("s12_write_archive", "segments", "select video_id, pos, text, 'segments' as stage from segments")
def s12(spark, sf):
    path = folder(spark)
    archive.write_archive(B.segments(spark, sf).withColumn("run_id", F.col("video_id") % 4), path, "segments")
    return spark.read.schema("video_id bigint, pos int, start_ms bigint, end_ms bigint, text string, run_id int, stage string").parquet(path).select("video_id", "pos", "text", "stage")


@query("s13_build_run_index", "run_index", "select task_id, case when cues % 3 = 0 or cues = 0 then 7 else cues end as cues from run_index")
def s13(spark, sf):
    r = B.run_index(spark, sf)
    counts = F.create_map(F.lit("post_reflow"), F.when(F.col("cues") % 3 == 0, 0).otherwise(F.col("cues")))
    return archive.build_run_index(r.withColumn("cue_counts", counts).withColumn("segments_count", F.lit(7))).select("task_id", "cues")


@query("s11_read_probe_json", "", """
select p_name || ['.mp4', '.MKV', '.bin'][p_partkey % 3 + 1] as filename, case when p_partkey % 4 = 1 then 0 else p_size * 10 end as width, case when p_partkey % 4 = 1 then 0 else p_size * 6 end as height,
       case when p_partkey % 4 = 1 or p_partkey % 5 = 0 then 0.0 else round(cast(p_size * 1000 as double) / (p_partkey % 5), 2) end as fps, round(p_retailprice, 2) as duration, case when p_partkey % 4 = 1 then 'unknown' else 'h264' end as codec,
       case when p_partkey % 2 = 1 then 'aac' else 'none' end as audio_codec, ['video/mp4', 'video/x-matroska', 'application/octet-stream'][p_partkey % 3 + 1] as mime_type
from part where p_partkey % 8 <> 4 """)
def s11(spark, sf):
    p, k = B.table(spark, sf, "part"), F.col("p_partkey")
    ext = F.element_at(F.array(F.lit(".mp4"), F.lit(".MKV"), F.lit(".bin")), (k % 3 + 1).cast("int"))
    video = F.concat(F.lit('{"codec_type":"video","codec_name":"h264","width":'), (F.col("p_size") * 10).cast("string"), F.lit(',"height":'), (F.col("p_size") * 6).cast("string"), F.lit(',"r_frame_rate":"'), (F.col("p_size") * 1000).cast("string"), F.lit("/"), (k % 5).cast("string"), F.lit('"}'))
    audio = F.lit('{"codec_type":"audio","codec_name":"aac"}')
    streams = F.array_compact(F.array(F.when((k % 4 != 1) & (k % 8 != 4), video), F.when(k % 2 == 1, audio)))
    js = F.concat(F.lit('{"streams":['), F.array_join(streams, ","), F.lit('],"format":{"duration":"'), F.round("p_retailprice", 4).cast("string"), F.lit('"}}'))
    return archive.read_probe_json(p.select(F.concat("p_name", ext).alias("filename"), js.alias("probe")))[0]


@query("s14_file_inventory")
def s14(spark, sf):
    return archive.file_inventory(spark, sf, "*.parquet").groupBy("folder").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


@query("a15_retention_report")
def a15(spark, sf):
    return archive.retention_report(archive.file_inventory(spark, sf, "*.parquet"), 0)


@query("f01_map_batches", "segments", "select video_id, pos, case when video_id % 3 = 1 then lower(text) else upper(replace(text, 'ß', 's')) end as result from segments")
def f01(spark, sf):
    """Services by name; every third video names one that is not there and gets the default."""
    rows = reflow.batch_by_count(B.segments(spark, sf, dealt=True), 20, 5000)
    named = rows.withColumn("service", F.element_at(F.array(F.lit("upper"), F.lit("lower"), F.lit("none such")), (F.pmod("video_id", F.lit(3)) + 1).cast("int")))
    services = {"upper": lambda texts: [t.replace("ß", "s").upper() for t in texts], "lower": lambda texts: [t.lower() for t in texts]}
    return batches.map_batches(named, concurrency=8, services=services, default="upper").select("video_id", "pos", "result")


@query("f02_retry", "segments", """
with b as (select *, (row_number() over (partition by video_id order by pos) - 1) // 20 as batch from segments), h as (select video_id, batch, length(arg_min(text, pos)) % 4 as failures from b group by all)
select video_id, pos, case when failures < 3 then upper(replace(text, 'ß', 's')) else text end as result, cast(least(failures + 1, 3) as integer) as attempts,
       case failures when 0 then 0 when 1 then 0.001 else 0.003 end::double as waited_s, failures = 3 as failed from b join h using (video_id, batch)""")
def f02(spark, sf):
    def flaky(texts, call):
        """Fails as often as the length of its first text says, each time with an error that may pass."""
        if call.attempt <= len(texts[0]) % 4:
            raise RuntimeError("HTTP 503" if call.attempt > 1 else "read timed out")
        return [t.replace("ß", "s").upper() for t in texts]

    rows = reflow.batch_by_count(B.segments(spark, sf, dealt=True).where("text is not null"), 20, 1 << 40)
    return batches.map_batches(rows, flaky, attempts=3, wait_s=0.001, keep_failed=True).select("video_id", "pos", "result", "attempts", F.round("waited_s", 6).alias("waited_s"), "failed")


@query("f04_measured", "segments", "select video_id, pos, case when start_ms % 9000 <> 0 then -start_ms / 1000.0::double end as energy_db from segments")
def f04(spark, sf):
    def level(start, end):
        if round(start * 1000) % 9000 == 0:
            raise ValueError("no sound")
        return -start

    return batches.measured(B.segments(spark, sf), level).select("video_id", "pos", "energy_db")


def ass_clock(ms: str) -> str:
    cs = f"cast(round_even({ms} / 10.0::double, 0) as bigint)"
    return f"printf('%d:%02d:%02d.%02d', {cs} // 360000, {cs} // 6000 % 60, {cs} // 100 % 60, {cs} % 100)"


@query("s10_write_ass_events", "cues", f"""with {spot_sql.wrap_ctes("cues", "video_id, cue_id, start_ms, end_ms")}
select video_id, cue_id, 'Dialogue: 0,' || {ass_clock("start_ms")} || ',' || {ass_clock("end_ms")} || ',Default,,0,0,0,,' || replace(translate(wrapped, '{{}}', '()'), chr(10), chr(92) || 'N') as line from wrapped""")
def s10(spark, sf):
    from cuelake.operators.layout import wrap_lines

    return tracks.write_ass_events(wrap_lines(B.cues(spark, sf)))


@query("s08_srt_plain_text", "cues", """
select video_id, string_agg(coalesce(nullif(trim(translated_text), ''), trim(text)), ' ' order by cue_id) filter (not regexp_matches(coalesce(nullif(trim(translated_text), ''), trim(text)), '^\\d+$') and not contains(coalesce(nullif(trim(translated_text), ''), trim(text)), '-->')) as plain from cues group by 1""")
def s08b(spark, sf):
    return tracks.srt_plain_text(tracks.write_srt(B.cues(spark, sf)))


@query("p19_safe_descriptions", "", r"""
select doc_id, coalesce(regexp_replace(substr(text, 1, 200), '[^\p{L}\p{N}_\s\p{Z}\-.,!?():]', '', 'g') || case when length(text) > 200 then '...' else '' end, '') as description from documents""")
def p19_descriptions(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", media.safe_description(F.col("text")).alias("description"))


@query("w19_transfer_progress", "", """
with recursive q as (
  select user_id as task_id, event_id, epoch_us(ts) / 1000000.0::double as t, row_number() over (partition by user_id order by ts, event_id) as i, cast(floor(value * 100) as bigint) as bytes, case when user_id % 4 <> 0 then 8000 + user_id % 9 * 100 end as total from events
), f as (
  select task_id, event_id, i, t as last_t, bytes as last_b, cast(null as double) as ema, false as hit, total from q where i = 1
  union all
  select q.task_id, q.event_id, q.i, case when q.t - last_t < 2 or bytes <= last_b then last_t else q.t end, case when q.t - last_t < 2 or bytes <= last_b then last_b else bytes end,
         case when q.t - last_t < 2 or bytes <= last_b then ema when ema is null then (bytes - last_b) / (q.t - last_t) else 0.3::double * ((bytes - last_b) / (q.t - last_t)) + 0.7::double * ema end, not (q.t - last_t < 2 or bytes <= last_b), q.total
  from f join q on q.task_id = f.task_id and q.i = f.i + 1
)
select task_id, event_id, case when total is not null then round(least(100.0::double, 100.0::double * last_b / total), 6) end as percent, case when total is not null then round(greatest(0.0::double, (total - last_b) / ema), 3) end as eta_s from f where hit""")
def w19_progress(spark, sf):
    u = F.col("user_id")
    moved = B.table(spark, sf, "events").select(u.alias("task_id"), "ts", "event_id", F.floor(F.col("value") * 100).cast("bigint").alias("bytes"), F.when(u % 4 != 0, 8000 + u % 9 * 100).alias("total_bytes"))
    return reflow.transfer_speed(moved).select("task_id", "event_id", F.round("percent", 6).alias("percent"), F.round("eta_s", 3).alias("eta_s"))
