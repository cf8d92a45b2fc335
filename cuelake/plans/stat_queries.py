"""Queries of statistics, runs, progress and replies, with their DuckDB SQL."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from cuelake.operators import jobstats as J
from cuelake.operators import replies as R
from cuelake.operators.text import content_duplicates
from cuelake.plans import bindings as B
from cuelake.plans.bindings import with_ctes

QUERIES, ORACLES = {}, {}


def query(name: str, ctes: str = "", sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_ctes(ctes, sql) if ctes else sql
        return f

    return add


LATEST = "select * from job_stats qualify row_number() over (partition by task_id order by created_at desc) = 1"


def saved(spark, sf):
    """A store after two upserts, with many tasks in both; of a task's rows of one time the first event's stays, as in the table's order."""
    from cuelake.plans.more_queries import folder
    from cuelake.sources.store import save_stats

    path, stats = folder(spark), B.job_stats(spark, sf, numbered=True)
    long = F.coalesce(F.col("total_duration") >= 50, F.lit(False))  # a row without a duration is in the second half
    for half in (stats.where(long), stats.where(~long)):
        save_stats(half, path, number="event_id")
    return path


@query("s03_save_stats", "job_stats", f"select task_id, created_at, status, total_duration, cast(created_at as date) as date from ({LATEST})")
def s03(spark, sf):
    from cuelake.sources.store import read_stats

    return read_stats(spark, saved(spark, sf)).select("task_id", "created_at", "status", "total_duration", "date")


@query("s03_read_indexed", "job_stats", f"select task_id, created_at, status, transcription_model, translation_service from ({LATEST}) where cast(created_at as date) between date '2024-01-05' and date '2024-01-12' and transcription_model = 'tiny' and status in ('failure', 'running')")
def s03_indexed(spark, sf):
    """Days, models and statuses are looked up in the manifest; other days are not opened."""
    from cuelake.sources.store import read_stats

    rows = read_stats(spark, saved(spark, sf), "2024-01-05", "2024-01-12", models=["tiny"], statuses=["failure", "running"])
    return rows.select("task_id", "created_at", "status", "transcription_model", "translation_service")


DAYS = """
with d as (select *, cast(created_at as date) as date, coalesce(transcription_model, 'unknown') as model, coalesce(translation_service, 'unknown') as service from job_stats),
m as (select date, list(model || '=' || n order by model) as l from (select date, model, count(*) as n from d group by all) group by date),
s as (select date, list(service || '=' || n order by service) as l from (select date, service, count(*) as n from d group by all) group by date)
select date, count(*) as total, count(*) filter (status = 'success') as succeeded, count(*) filter (status = 'failure') as failed, round(sum(translation_cost_usd), 4) as cost_usd,
       round(sum(total_duration), 2) as total_time, round(sum(total_duration) / count(*), 2) as avg_time, array_to_string(any_value(m.l), ',') as models, array_to_string(any_value(s.l), ',') as services
from d join m using (date) join s using (date) group by date"""


@query("a01_daily_summary", "job_stats", DAYS)
def a01(spark, sf):
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return J.daily_summary(B.job_stats(spark, sf)).select("date", "total", "succeeded", "failed", "cost_usd", "total_time", "avg_time", flat("by_model").alias("models"), flat("by_translation_service").alias("services"))


@query("a01_days_asked_for", "job_stats", """
with asked as (select distinct cast(o_orderdate as date) as date from orders union select date '2024-01-05'), d as (select cast(created_at as date) as date, * exclude (created_at) from job_stats)
select a.date, count(d.date) as total, count(*) filter (status = 'success') as succeeded, count(*) filter (status = 'failure') as failed, coalesce(round(sum(translation_cost_usd), 4), 0) as cost_usd,
       coalesce(round(sum(total_duration), 2), 0) as total_time, round(sum(total_duration) / nullif(count(d.date), 0), 2) as avg_time, count(distinct coalesce(transcription_model, 'unknown')) filter (d.date is not null) as models
from asked a left join d on d.date = a.date group by a.date""")
def a01_asked(spark, sf):
    """Days of orders, most of which have no jobs."""
    asked = B.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).union(spark.sql("select date'2024-01-05'"))
    days = J.daily_summary(B.job_stats(spark, sf), asked)
    return days.select("date", "total", "succeeded", "failed", "cost_usd", "total_time", "avg_time", F.size("by_model").cast("bigint").alias("models"))


@query("a02_model_performance", "job_stats", """
with r as (select *, case when status = 'success' and transcription_speed_ratio > 0 then transcription_speed_ratio end as ratio from job_stats where cast(created_at as date) >= (select max(cast(created_at as date)) - 9 from job_stats))
select coalesce(transcription_model, 'unknown') as model, count(*) as total, count(*) filter (status = 'success') as succeeded, round(avg(total_duration) filter (status = 'success'), 4) as avg_time,
       round(avg(ratio), 4) as avg_ratio, min(ratio) as min_ratio, max(ratio) as max_ratio from r group by 1""")
def a02(spark, sf):
    return J.model_performance(B.job_stats(spark, sf), days=10)


@query("a03_cost_breakdown", "job_stats", """
select translation_service, round(sum(translation_cost_usd), 6) as cost_usd, cast(sum(translation_tokens) as bigint) as tokens, count(*) as videos from job_stats
where cast(created_at as date) between date '2024-01-20' - 6 and date '2024-01-20' group by rollup (translation_service)""")
def a03(spark, sf):
    return J.cost_breakdown(B.job_stats(spark, sf), "2024-01-20", 7)


@query("a04_success_by_model", "job_stats", """
with s as (select coalesce(transcription_model, 'unknown') as model, round(100 * avg(cast(status = 'success' as int)), 4) as success_rate, round(avg(total_duration), 4) as avg_time from job_stats group by 1)
select *, cast(row_number() over (order by avg_time, model) as integer) as speed_rank from s""")
def a04(spark, sf):
    return J.success_by_model(B.job_stats(spark, sf))


@query("a05_duration_band", "job_stats", "select count(*) as videos, round(avg(total_duration), 4) as avg_time, round(avg(translation_tokens), 4) as avg_tokens from job_stats where video_duration between 40 and 400")
def a05(spark, sf):
    return J.duration_band(B.job_stats(spark, sf), 40, 400)


@query("a06_slow_outliers", "job_stats", "select task_id, created_at, total_duration from job_stats where total_duration > (select avg(total_duration) + 2 * stddev_samp(total_duration) from job_stats)")
def a06(spark, sf):
    return J.slow_outliers(B.job_stats(spark, sf)).select("task_id", "created_at", "total_duration")


@query("a07_daily_trend", "job_stats", "select cast(created_at as date) as date, round(avg(total_duration), 4) as avg_time from job_stats group by 1")
def a07(spark, sf):
    return J.daily_trend(B.job_stats(spark, sf))


@query("k01_extremes", "job_stats", "select task_id, created_at, total_duration from job_stats order by total_duration desc, task_id, created_at limit 20")
def k01(spark, sf):
    return J.extremes(B.job_stats(spark, sf), 20).select("task_id", "created_at", "total_duration")


@query("k02_slowest_per_model", "job_stats", "select transcription_model, task_id, total_duration, cast(row_number() over (partition by transcription_model order by total_duration desc, task_id, created_at) as integer) as rank from job_stats qualify rank <= 5")
def k02(spark, sf):
    return J.extremes(B.job_stats(spark, sf), 5, per="transcription_model").select("transcription_model", "task_id", "total_duration", "rank")


@query("j06_stats_lookup", "job_stats", "select task_id, created_at, total_duration from job_stats where task_id in (select cast(o_orderkey as varchar) from orders)")
def j06(spark, sf):
    keys = B.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("task_id"))
    return J.stats_by_task(B.job_stats(spark, sf), keys).select("task_id", "created_at", "total_duration")


@query("j06_stats_by_date", "job_stats", "select task_id, created_at, total_duration from job_stats where cast(created_at as date) between date '2024-01-05' and date '2024-01-12'")
def j06_date(spark, sf):
    return J.stats_by_date(B.job_stats(spark, sf), "2024-01-05", "2024-01-12").select("task_id", "created_at", "total_duration")


@query("j06_stats_by_model", "job_stats", """
select transcription_model, task_id, created_at from job_stats where transcription_model in ('tiny', 'base') qualify row_number() over (partition by transcription_model order by created_at desc, task_id) <= 25""")
def j06_model(spark, sf):
    return J.stats_by_model(B.job_stats(spark, sf), ["tiny", "base"], 25).select("transcription_model", "task_id", "created_at")


@query("k03_newest_first", "", "select user_id, event_id, ts, cast(row_number() over (partition by user_id order by ts desc, event_id) as integer) as rank from events qualify rank <= 3")
def k03_newest(spark, sf):
    return J.ranked(B.table(spark, sf, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 3)


@query("j09_compare_runs", "run_index", """
with newest as (select * from run_index qualify row_number() over (partition by video, pipeline order by run_at desc, task_id desc) = 1)
select a.video, a.task_id as task_id_a, b.task_id as task_id_b, b.cues - a.cues as cues_diff, round(b.cost_usd - a.cost_usd, 4) as cost_diff, b.over_budget - a.over_budget as over_budget_diff
from newest a join newest b on a.video = b.video and a.pipeline = 'F' and b.pipeline = 'O'""")
def j09(spark, sf):
    return J.compare_runs(B.run_index(spark, sf), "F", "O")


@query("a09_overall_progress", "progress_events", """
with p as (select task_id, greatest(0, least(100, progress)) as p, step_index + 1 as weight from progress_events)
select task_id, cast(least(100, floor(sum(p * weight) / sum(weight))) as bigint) as percent, cast(floor(sum(p * weight) / 100) as bigint) as plain from p group by 1""")
def a09(spark, sf):
    return J.overall_progress(B.progress_events(spark, sf).withColumn("weight", F.col("step_index") + 1))


@query("w20_latest_status", "progress_events", """
with l as (select task_id, step_index, greatest(0, least(100, arg_max(progress, (ts, event_id)))) as progress, max(cast(message = 'error' as int)) as e from progress_events group by all)
select task_id, step_index, progress, case when e = 1 then 'error' when progress = 0 then 'waiting' when progress = 100 then 'completed' else 'in_progress' end as status from l""")
def w20(spark, sf):
    return J.latest_status(B.progress_events(spark, sf))


@query("w20_log_tail", "progress_events", """
with l as (select * from progress_events qualify row_number() over (partition by task_id order by ts desc, event_id desc) <= 50)
select task_id, string_agg(message, ',' order by ts, event_id) as tail from l group by 1""")
def w20_tail(spark, sf):
    return J.log_tail(B.progress_events(spark, sf))


@query("w21_concurrency", "", """
with e as (select o_custkey, epoch_us(o_orderdate) as t, 1 as d from orders union all select o_custkey, epoch_us(o_orderdate) + (o_orderkey % 90 + 1) * 86400000000, -1 from orders),
o as (select *, sum(d) over (partition by o_custkey order by t, d rows unbounded preceding) as n from e)
select o_custkey, cast(max(n) as bigint) as most_open from o group by 1""")
def w21(spark, sf):
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    o = B.table(spark, sf, "orders").select("o_custkey", start.alias("start"), (start + (F.col("o_orderkey") % 90 + 1) * 86_400_000_000).alias("stop"))
    return J.concurrency(o, "o_custkey")


TOKENS = """issues as (select event_id as token, ts from events where event_id % 3 <> 0), uses as (
  select event_id as use_id, event_id - event_id % 5 as token, ts from events where event_type <> 'view')"""


def token_tables(spark, sf):
    e = B.table(spark, sf, "events")
    return e.where("event_id % 3 <> 0").select(F.col("event_id").alias("token"), "ts"), e.where("event_type <> 'view'").select(F.col("event_id").alias("use_id"), (F.col("event_id") - F.col("event_id") % 5).alias("token"), "ts")


REDEEM = f"""
with {TOKENS}, m as (select use_id, u.token, u.ts, i.ts as issued, coalesce(u.ts >= i.ts, false) as live from uses u left join issues i on u.token = i.token),
n as (select *, row_number() over (partition by token, live order by ts, use_id) as k from m)
select use_id, token, case when not live then 'invalid' when k > 1 then 'used' when epoch_us(ts) - epoch_us(issued) > 300000000 then 'expired' else 'ok' end as verdict from n"""


@query("j11_redeem_tokens", "", REDEEM)
def j11(spark, sf):
    return J.redeem_tokens(*token_tables(spark, sf))


@query("a14_token_status", "", """
with t as (select epoch_us(timestamp '2024-01-15 00:00:00') - epoch_us(ts) > 300000000 as old, event_type = 'click' as used from events)
select count(*) as total, count(*) filter (old) as expired, count(*) filter (used and not old) as used, count(*) filter (not used and not old) as active from t""")
def a14(spark, sf):
    t = B.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("issued"), (F.col("event_type") == "click").alias("used"))
    return J.token_status(t, F.lit("2024-01-15 00:00:00").cast("timestamp"))


RATES = {"error": (0.5, 1.5), "view": (0.25, 2.0), "click": (1.25, 5.0)}


@query("a10_usage_rollup", "progress_events", """
with c as (select task_id as run_id, step_index as stage, message as model, tokens as prompt_tokens, tokens // 5 as completion_tokens, message = 'error' as failed from progress_events),
p as (select *, prompt_tokens / 1000000 * case model when 'error' then 0.5 when 'click' then 1.25 else 0.25 end::double + completion_tokens / 1000000 * case model when 'error' then 1.5 when 'click' then 5.0 else 2.0 end::double as cost from c)
select run_id, stage, model, cast(sum(prompt_tokens) as bigint) as prompt_tokens, cast(sum(completion_tokens) as bigint) as completion_tokens, count(*) as requests, count(*) filter (failed) as unanswered, cast(round(sum(cast(cost as decimal(20, 10))), 6) as double) as cost_usd from p group by rollup (run_id, stage, model)""")
def a10(spark, sf):
    calls = B.progress_events(spark, sf).select(F.col("task_id").alias("run_id"), F.col("step_index").alias("stage"), F.col("message").alias("model"), F.col("tokens").alias("prompt_tokens"), F.floor(F.col("tokens") / 5).alias("completion_tokens"), F.when(F.col("message") == "error", "e").alias("error"))
    return J.usage_rollup(calls, RATES, "view")


@query("t01_budget_windows", "progress_events", """
select time_bucket(interval '1 day', ts) as start, cast(sum(tokens) as bigint) as tokens, count(*) as requests, sum(tokens) > 20000 or count(*) > 60 as over from progress_events group by 1""")
def t01(spark, sf):
    return J.budget_windows(B.progress_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("t02_admit_requests", "progress_events", """
with recursive q as (
  select *, row_number() over (partition by task_id, cast(ts as date) order by ts, event_id) as i, cast(ts as date) as d from progress_events
), f as (
  select task_id, d, i, event_id, tokens <= 600 as admitted, case when tokens <= 600 then tokens else 0 end as used, case when tokens <= 600 then 1 else 0 end as n from q where i = 1
  union all
  select q.task_id, q.d, q.i, q.event_id, f.used + q.tokens <= 600 and f.n + 1 <= 3, f.used + case when f.used + q.tokens <= 600 and f.n + 1 <= 3 then q.tokens else 0 end, f.n + case when f.used + q.tokens <= 600 and f.n + 1 <= 3 then 1 else 0 end
  from f join q on q.task_id = f.task_id and q.d = f.d and q.i = f.i + 1
)
select task_id, event_id, admitted from f""")
def t02(spark, sf):
    return J.admit_requests(B.progress_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "1 day", 600, 3)


SLIDING = """
with w as (select task_id, unnest(generate_series(time_bucket(interval '6 hours', ts) - interval '18 hours', time_bucket(interval '6 hours', ts), interval '6 hours')) as start from progress_events)
select task_id, start, count(*) as requests from w group by all having count(*) > 5"""


@query("t03_route_limits", "progress_events", SLIDING)
def t03(spark, sf):
    return J.route_limits(B.progress_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "24 hours", "6 hours", 5).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("a17_error_frequency", "", """
with l as (select ts, case event_type when 'error' then 'ERROR' when 'click' then 'CRITICAL' else 'INFO' end || ' worker-' || user_id % 20 || ' gave up' as line from events)
select line, count(*) as n from l where ts > timestamp '2024-01-15 12:00:00' - interval '24 hours' and ts <= timestamp '2024-01-15 12:00:00' and regexp_matches(line, 'ERROR|CRITICAL|Exception') group by 1""")
def a17(spark, sf):
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "CRITICAL").otherwise("INFO")
    logs = B.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(level, F.lit(" worker-"), (F.col("user_id") % 20).cast("string"), F.lit(" gave up")).alias("line"))
    return J.error_frequency(logs, F.lit("2024-01-15 12:00:00").cast("timestamp"), 24)


@query("a18_run_metrics", "", """
with l as (select user_id % 5 as test, 'batch took ' || round(value, 2) || 's on worker-' || user_id % 4 || ' in flight ' || event_id % 9 as line from events)
select test, round(sum(cast(regexp_extract(line, 'took ([0-9.]+)s', 1) as double)), 2) as total_s, round(avg(cast(regexp_extract(line, 'took ([0-9.]+)s', 1) as double)), 4) as avg_s, min(cast(regexp_extract(line, 'took ([0-9.]+)s', 1) as double)) as min_s, max(cast(regexp_extract(line, 'took ([0-9.]+)s', 1) as double)) as max_s,
       count(distinct regexp_extract(line, 'worker-([0-9]+)', 1)) as workers, max(cast(regexp_extract(line, 'in flight ([0-9]+)', 1) as integer)) as in_flight from l group by 1""")
def a18(spark, sf):
    from cuelake.sources.logs import read_worker_logs, run_metrics

    line = F.concat(F.lit("batch took "), F.round("value", 2).cast("string"), F.lit("s on worker-"), (F.col("user_id") % 4).cast("string"), F.lit(" in flight "), (F.col("event_id") % 9).cast("string"))
    return run_metrics(read_worker_logs(B.table(spark, sf, "events").select((F.col("user_id") % 5).alias("test"), line.alias("line"))))


@query("a18_sketched_metrics", "", """
select user_id % 5 as test, count(*) as batches, round(sum(round(value, 2)), 2) as total_s, min(round(value, 2)) as min_s, max(round(value, 2)) as max_s, count(distinct user_id % 4) as workers, true as near from events group by 1""")
def a18_sketched(spark, sf):
    """Stored sketches of each day, merged; ``near``: the true rank of each quantile is within 4 % of its share."""
    from cuelake.plans.more_queries import folder
    from cuelake.sources.logs import merged_metrics, metric_sketches

    shares, path = (0.5, 0.9, 0.99), folder(spark)
    rows = B.table(spark, sf, "events").select((F.col("user_id") % 5).alias("test"), F.to_date("ts").alias("date"), F.round("value", 2).alias("batch_s"), (F.col("user_id") % 4).cast("string").alias("worker"))
    metric_sketches(rows).write.partitionBy("date").parquet(path)
    merged = merged_metrics(spark.read.parquet(path), shares)
    ranks = rows.join(F.broadcast(merged.select("test", "quantiles")), "test").groupBy("test").agg(*(F.avg((F.col("batch_s") <= F.col("quantiles")[k]).cast("double")).alias(f"r{k}") for k in range(len(shares))))
    near = functools.reduce(lambda a, b: a & b, (F.abs(F.col(f"r{k}") - s) < 0.04 for k, s in enumerate(shares)))
    return merged.join(ranks, "test").select("test", "batches", "total_s", "min_s", "max_s", F.col("workers").cast("bigint").alias("workers"), near.alias("near"))


BUDGETS = """
with e as (select * from progress_events where message <> 'view'), w as (
  select '1 day' as width, task_id, time_bucket(interval '6 hours', ts) - interval '6 hours' * k as start from e, range(4) r(k) union all
  select '12 hours', task_id, time_bucket(interval '6 hours', ts) - interval '6 hours' * k from e, range(2) r(k))
select width, task_id, start, count(*) as requests from w group by all having count(*) > case width when '1 day' then 4 else 2 end"""


@query("t03_route_budgets", "progress_events", BUDGETS)
def t03_budgets(spark, sf):
    """Two limits at once; polling routes are exempt."""
    rows = B.progress_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return J.route_budgets(rows, {"1 day": 4, "12 hours": 2}, "6 hours", ["view"], "message").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("a16_content_duplicates", "", """
with d as (select doc_id, sha256(text) as digest from documents)
select digest, count(*) as copies, min(doc_id) as first_id from d group by 1 having count(*) > 1""")
def a16(spark, sf):
    return content_duplicates(B.table(spark, sf, "documents"), "doc_id", "text")


REPLIES = """asked as (
  select video_id, cast((cue_id - 1) // 10 as integer) as chunk, cue_id as id, text from cues
), sent as (
  select video_id, chunk, id, upper(replace(text, 'ß', 's')) as reply, 2 * id as ord from asked where id % 7 <> 0
  union all select video_id, chunk, id + 5000, 'extra', 2 * id + 1 from asked where id % 11 = 5
), items as (
  select video_id, chunk, id, trim(reply) as reply, ord from sent where (video_id + chunk) % 10 <> 4 and trim(reply) <> ''
)"""


def requests(spark, sf):
    return B.cues(spark, sf).select("video_id", F.floor((F.col("cue_id") - 1) / 10).cast("int").alias("chunk"), F.col("cue_id").alias("id"), "text")


def parsed(spark, sf):
    return R.parse_replies(B.replies(spark, sf))[0]


@query("f03_parse_replies", "cues", f"with {REPLIES} select video_id, chunk, id, reply as text from items")
def f03(spark, sf):
    return parsed(spark, sf).select("video_id", "chunk", "id", "text")


@query("j03_merge_replies_by_id", "cues", f"""with {REPLIES}
select coalesce(a.video_id, i.video_id) as video_id, coalesce(a.chunk, i.chunk) as chunk, coalesce(a.id, i.id) as id, case when a.id is null then 'extra' when i.id is null then 'missing' else 'ok' end as status, case when a.id is not null then i.reply end as reply
from asked a full join items i on a.video_id = i.video_id and a.chunk = i.chunk and a.id = i.id""")
def j03(spark, sf):
    return R.merge_replies_by_id(requests(spark, sf), parsed(spark, sf))


@query("j04_missing_reply_worklist", "cues", f"""with {REPLIES}, m as (
  select a.*, i.id is null as gone from asked a left join (select distinct video_id, chunk, id from items) i using (video_id, chunk, id))
select video_id, chunk, list(id order by id) filter (gone) as missing_ids, coalesce(list(id order by id) filter (not gone), []) as context_ids from m group by all having bool_or(gone)""")
def j04(spark, sf):
    return R.missing_reply_worklist(requests(spark, sf), parsed(spark, sf))


@query("j05_fill_or_fail", "cues", f"with {REPLIES} select a.video_id, a.chunk, a.id, coalesce(i.reply, a.text) as reply, i.reply is null as filled from asked a left join items i on a.video_id = i.video_id and a.chunk = i.chunk and a.id = i.id")
def j05(spark, sf):
    return R.fill_or_fail(requests(spark, sf), parsed(spark, sf)).select("video_id", "chunk", "id", "reply", "filled")


@query("j05_fill_by_position", "cues", """
with asked as (select video_id, cast((cue_id - 1) // 10 as integer) as chunk, cue_id as id, text, (cue_id - 1) % 10 as i from cues), n as (select video_id, chunk, count(*) as n from asked group by all),
g as (select *, case (video_id + chunk) % 4 when 0 then n when 1 then n - 2 when 2 then n + 3 else null end as given from n)
select a.video_id, a.chunk, a.id, case when i < greatest(0, coalesce(given, 0)) then 'r' || i else text end as reply, i >= greatest(0, coalesce(given, 0)) as filled, greatest(0, coalesce(given, 0) - n) as excess, n - least(n, greatest(0, coalesce(given, 0))) as shortage
from asked a join g using (video_id, chunk)""")
def j05_position(spark, sf):
    asked = B.cues(spark, sf).select("video_id", F.floor((F.col("cue_id") - 1) / 10).cast("int").alias("chunk"), F.col("cue_id").alias("id"), "text")
    n, k = F.count("*"), F.pmod(F.col("video_id") + F.col("chunk"), F.lit(4))
    given = F.when(k == 0, F.col("n")).when(k == 1, F.greatest(F.lit(0), F.col("n") - 2)).when(k == 2, F.col("n") + 3)
    counts = asked.groupBy("video_id", "chunk").agg(n.alias("n")).withColumn("given", given)
    texts = F.when(F.col("given") > 0, F.transform(F.sequence(F.lit(0), F.col("given") - 1), lambda i: F.concat(F.lit("r"), i.cast("string")))).when(F.col("given") == 0, F.array().cast("array<string>"))
    return R.fill_by_position(asked, counts.select("video_id", "chunk", texts.alias("texts"))).select("video_id", "chunk", "id", "reply", "filled", "excess", "shortage")


@query("u01_id_differences", "cues", f"""with {REPLIES}, e as (select video_id, chunk, id from asked), f as (select video_id, chunk, id from items)
select *, 'missing' as side from (select * from e except select * from f) union all select *, 'extra' from (select * from f except select * from e)""")
def u01(spark, sf):
    return R.id_differences(requests(spark, sf), parsed(spark, sf))


@query("a12_correction_rate", "cues", """
with a as (select video_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) = trim(regexp_replace(translated_text, '\\s+', ' ', 'g')) as same from cues where trim(text) <> '' and trim(translated_text) <> '')
select video_id, count(*) as asked, count(*) filter (same) as unchanged, count(*) filter (not same) as corrected from a group by 1""")
def a12(spark, sf):
    return R.correction_rate(B.cues(spark, sf))
