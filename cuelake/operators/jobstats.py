"""Job statistics, run comparison, progress, tokens and their summaries."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType
from pyspark.sql.window import Window

from cuelake.operators.passes import ordered_pass


def is_status(name: str) -> Column:
    return F.col("status") == name


def latest_per_task(stats: DataFrame, number: str | None = None) -> DataFrame:
    """Keyed store: rows without a task go, the latest row of a task wins; adds ``date``.

    Of rows of one time the one of the least ``number``, a column that numbers rows as they came, wins; without it, or if that is one too, the one of the
    greatest other values.  A row without ``created_at`` is taken to be of now.
    """
    rest = sorted(c for c in stats.columns if c not in ("task_id", "created_at", number) and stats.schema[c].dataType.typeName() != "map")
    came = [] if number is None else [F.asc_nulls_last(number)]
    order = Window.partitionBy("task_id").orderBy(F.desc("created_at"), *came, *(F.desc(c) for c in rest))
    kept = stats.withColumn("created_at", F.coalesce("created_at", F.current_timestamp().cast(stats.schema["created_at"].dataType))).where("task_id is not null").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return kept.withColumn("date", F.to_date("created_at"))


def stats_by_task(stats: DataFrame, tasks: DataFrame) -> DataFrame:
    """Rows of the tasks in a table of task_id."""
    return stats.join(tasks.select("task_id"), "task_id", "left_semi").select(stats.columns)


def stats_by_date(stats: DataFrame, first: str, last: str) -> DataFrame:
    """Rows of the days from first to last; a read of the keyed store takes the same edges and opens only those days."""
    date = F.col("date") if "date" in stats.columns else F.to_date("created_at")
    return stats.where(date.between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))


def stats_by_model(stats: DataFrame, models: list[str], limit: int | None = None) -> DataFrame:
    """Rows of some models, newest first; with a limit that many of each model, ties by task."""
    own = stats.where(F.col("transcription_model").isin(*models))
    if limit is None:
        return own
    order = Window.partitionBy("transcription_model").orderBy(F.desc("created_at"), "task_id")
    return own.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit).drop("__n")


def daily_partials(stats: DataFrame) -> DataFrame:
    """Mergeable sums of each (date, model, service), null names being ``unknown``: rows of several calls may be put together."""
    named = [F.coalesce(c, F.lit("unknown")).alias(n) for c, n in (("transcription_model", "model"), ("translation_service", "service"))]
    df = stats.select(F.to_date("created_at").alias("date"), *named, "status", "translation_cost_usd", "total_duration")
    return df.groupBy("date", "model", "service").agg(
        F.count("*").alias("n"), F.count_if(is_status("success")).alias("ok"), F.count_if(is_status("failure")).alias("bad"), F.sum("translation_cost_usd").alias("cost"), F.sum("total_duration").alias("time")
    )


def merged_days(partials: DataFrame) -> DataFrame:
    """``daily_partials`` that were made in parts, put together."""
    return partials.groupBy("date", "model", "service").agg(*(F.sum(c).alias(c) for c in ("n", "ok", "bad", "cost", "time")))


def days_of(partials: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """The daily summary of ``daily_partials``, by grouping sets over few rows a day; ``dates`` (column date) are what is asked for.

    A date that was asked for and has no rows gives a zero row without an average.
    """
    date, model, service = F.col("date"), F.col("model"), F.col("service")
    sums = [F.sum(c).alias(c) for c in ("n", "ok", "bad", "cost", "time")]
    sets = partials.groupingSets([[date], [date, model], [date, service]], date, model, service).agg(F.grouping_id().alias("level"), *sums)
    whole = lambda c: F.max(F.when(F.col("level") == 3, F.col(c)))
    counts = lambda level, c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("level") == level, F.struct(F.col(c).alias("k"), "n")))))
    out = sets.groupBy("date").agg(
        whole("n").alias("total"), whole("ok").alias("succeeded"), whole("bad").alias("failed"), F.round(whole("cost"), 4).alias("cost_usd"),
        F.round(whole("time"), 2).alias("total_time"), F.round(whole("time") / whole("n"), 2).alias("avg_time"), counts(1, "model").alias("by_model"), counts(2, "service").alias("by_translation_service"),
    )
    if dates is None:
        return out
    none = F.create_map().cast("map<string,bigint>")
    asked = dates.select("date").where("date is not null").distinct().join(out, "date", "left")
    zeros = {"total": 0, "succeeded": 0, "failed": 0, "cost_usd": 0.0, "total_time": 0.0}
    filled = [F.coalesce(c, F.lit(v)).alias(c) for c, v in zeros.items()]
    return asked.select("date", *filled, "avg_time", *(F.coalesce(c, none).alias(c) for c in ("by_model", "by_translation_service")))


def daily_summary(stats: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Per date: totals, cost, time, average over all rows, and counts by model and by service as maps (null: unknown).

    With ``dates`` (column date) one row for each of them, zeros for those without jobs.
    """
    return days_of(daily_partials(stats), dates)


def model_performance(stats: DataFrame, days: int | None = None) -> DataFrame:
    """Per model: total, succeeded, mean time of successes, and mean, least and most of positive speed ratios."""
    df = stats
    if days is not None:
        last = stats.agg(F.date_sub(F.to_date(F.max("created_at")), days - 1).alias("first"))
        df = df.join(F.broadcast(last)).where(F.to_date("created_at") >= F.col("first")).drop("first")
    ratio = F.when(is_status("success") & (F.col("transcription_speed_ratio") > 0), F.col("transcription_speed_ratio"))
    return df.groupBy(F.coalesce("transcription_model", F.lit("unknown")).alias("model")).agg(
        F.count("*").alias("total"), F.count_if(is_status("success")).alias("succeeded"), F.round(F.avg(F.when(is_status("success"), F.col("total_duration"))), 4).alias("avg_time"),
        F.round(F.avg(ratio), 4).alias("avg_ratio"), F.min(ratio).alias("min_ratio"), F.max(ratio).alias("max_ratio"),
    )


def cost_breakdown(stats: DataFrame, date: str, days: int) -> DataFrame:
    """Cost, tokens and videos per service over the days up to ``date``, and in total (null service)."""
    last = F.lit(date).cast("date")
    df = stats.where(F.to_date("created_at").between(F.date_sub(last, days - 1), last))
    return df.rollup("translation_service").agg(F.round(F.sum("translation_cost_usd"), 6).alias("cost_usd"), F.sum("translation_tokens").alias("tokens"), F.count("*").alias("videos"))


def success_by_model(stats: DataFrame) -> DataFrame:
    """Success rate in percent and mean time by model, fastest first by ``speed_rank``."""
    df = stats.groupBy(F.coalesce("transcription_model", F.lit("unknown")).alias("model")).agg(F.round(100 * F.avg(is_status("success").cast("double")), 4).alias("success_rate"), F.round(F.avg("total_duration"), 4).alias("avg_time"))
    return df.withColumn("speed_rank", F.row_number().over(Window.orderBy("avg_time", "model")))


def duration_band(stats: DataFrame, low: float, high: float) -> DataFrame:
    """Means of videos whose length lies in a band."""
    return stats.where(F.col("video_duration").between(low, high)).agg(F.count("*").alias("videos"), F.round(F.avg("total_duration"), 4).alias("avg_time"), F.round(F.avg("translation_tokens"), 4).alias("avg_tokens"))


def slow_outliers(stats: DataFrame, k: float = 2.0) -> DataFrame:
    """Rows over the mean plus k sample standard deviations; the one row of statistics is broadcast."""
    limit = stats.agg((F.avg("total_duration") + k * F.stddev_samp("total_duration")).alias("limit"))
    return stats.join(F.broadcast(limit)).where(F.col("total_duration") > F.col("limit")).drop("limit")


def daily_trend(stats: DataFrame) -> DataFrame:
    return stats.groupBy(F.to_date("created_at").alias("date")).agg(F.round(F.avg("total_duration"), 4).alias("avg_time"))


def extremes(stats: DataFrame, k: int, slowest: bool = True, per: str | None = None) -> DataFrame:
    """The k slowest or fastest rows, ties by task and time; ``per`` a column: of each of its values."""
    order = [F.desc("total_duration") if slowest else F.asc("total_duration"), "task_id", "created_at"]
    if per is None:
        return stats.orderBy(*order).limit(k)
    return stats.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("rank") <= k)


def compare_runs(runs: DataFrame, a: str, b: str) -> DataFrame:
    """Per video archived under both pipelines: differences b - a of the latest run of each; null over_budget stays null."""
    newest = runs.withColumn("__n", F.row_number().over(Window.partitionBy("video", "pipeline").orderBy(F.desc("run_at"), F.desc("task_id")))).where("__n = 1")
    side = lambda p, s: newest.where(F.col("pipeline") == p).select("video", *(F.col(c).alias(f"{c}_{s}") for c in ("task_id", "cues", "cost_usd", "over_budget")))
    both = side(a, "a").join(side(b, "b"), "video")
    return both.select("video", "task_id_a", "task_id_b", (F.col("cues_b") - F.col("cues_a")).alias("cues_diff"), F.round(F.col("cost_usd_b") - F.col("cost_usd_a"), 4).alias("cost_diff"), (F.col("over_budget_b") - F.col("over_budget_a")).alias("over_budget_diff"))


def overall_progress(steps: DataFrame) -> DataFrame:
    """Per task: weighted percent, normalised and capped at 100, and as plain sum."""
    p = F.greatest(F.lit(0), F.least(F.lit(100), F.col("progress")))
    return steps.groupBy("task_id").agg(F.least(F.lit(100), F.floor(F.sum(p * F.col("weight")) / F.sum("weight"))).alias("percent"), F.floor(F.sum(p * F.col("weight")) / 100).alias("plain"))


def latest_status(progress: DataFrame) -> DataFrame:
    """Newest state of each task and step; progress is held within 0 and 100 and names the status, an error sticks."""
    newest = progress.groupBy("task_id", "step_index").agg(F.max_by("progress", F.struct("ts", "event_id")).alias("progress"), F.max((F.col("message") == "error").cast("int")).alias("__error"))
    held = F.greatest(F.lit(0), F.least(F.lit(100), F.col("progress"))).cast("bigint")
    status = F.when(F.col("__error") == 1, "error").when(held == 0, "waiting").when(held == 100, "completed").otherwise("in_progress")
    return newest.select("task_id", "step_index", held.alias("progress"), status.alias("status"))


def log_tail(progress: DataFrame, n: int = 50) -> DataFrame:
    """The last n messages of each task, in order; only n rows a task are gathered."""
    order = Window.partitionBy("task_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = progress.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n)
    return last.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "message"))), lambda x: x["message"]), ",").alias("tail"))


def concurrency(intervals: DataFrame, key: str, slot: int = 86_400_000_000) -> DataFrame:
    """Per key: the most intervals [start, stop) open at once, by a sweep over their ends; start and stop are bigint.

    Running sums have two levels: over the sums of slots of time, then inside each slot from what was open before it.  So a key
    that holds a third of all intervals is dealt over its slots; only its sums by slot, a row each, are in one window.
    """
    edges = intervals.select(key, F.col("start").alias("t"), F.lit(1).alias("d")).unionByName(intervals.select(key, F.col("stop").alias("t"), F.lit(-1).alias("d")))
    placed = edges.withColumn("slot", F.floor(F.col("t") / slot))
    sums = placed.groupBy(key, "slot").agg(F.sum("d").alias("d"))
    before = F.coalesce(F.sum("d").over(Window.partitionBy(key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    opened = sums.select(F.col(key).alias("__of"), F.col("slot").alias("__slot"), before.alias("before"))
    inside = F.sum("d").over(Window.partitionBy(key, "slot").orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0))
    peaks = placed.withColumn("inside", inside).groupBy(key, "slot").agg(F.max("inside").alias("peak"))
    return peaks.join(opened, F.col(key).eqNullSafe(F.col("__of")) & F.col("slot").eqNullSafe(F.col("__slot"))).groupBy(key).agg(F.max(F.col("before") + F.col("peak")).alias("most_open"))


def redeem_tokens(issues: DataFrame, uses: DataFrame, life_s: int = 300) -> DataFrame:
    """Each use's verdict: invalid (no such token at the time), used (not the first use), expired (later than its life) or ok."""
    df = uses.join(issues.select("token", F.col("ts").alias("issued")), "token", "left").withColumn("__live", F.coalesce(F.col("ts") >= F.col("issued"), F.lit(False)))
    df = df.withColumn("__n", F.row_number().over(Window.partitionBy("token", "__live").orderBy("ts", "use_id")))
    verdict = F.when(~F.col("__live"), "invalid").when(F.col("__n") > 1, "used").when(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("issued").cast("timestamp")) > life_s * 1_000_000, "expired").otherwise("ok")
    return df.select("use_id", "token", verdict.alias("verdict"))


def token_status(tokens: DataFrame, now: Column, life_s: int = 300) -> DataFrame:
    """Counts of tokens: total, expired, used, active."""
    old = F.unix_micros(now) - F.unix_micros("issued") > life_s * 1_000_000
    return tokens.agg(F.count("*").alias("total"), F.count_if(old).alias("expired"), F.count_if(F.col("used") & ~old).alias("used"), F.count_if(~F.col("used") & ~old).alias("active"))


def call_cost(rates: dict[str, tuple[float, float]], default: str) -> Column:
    """Dollars of a call (model, prompt_tokens, completion_tokens) at rates per million tokens in and out; unknown models cost the default's."""
    pairs = F.create_map(*(F.lit(x) for name, (a, b) in rates.items() for x in (name, F.array(F.lit(float(a)), F.lit(float(b))))))
    rate = F.coalesce(F.try_element_at(pairs, F.coalesce("model", F.lit(default))), F.array(*(F.lit(float(x)) for x in rates[default])))
    return F.coalesce("prompt_tokens", F.lit(0)) / 1_000_000 * rate[0] + F.coalesce("completion_tokens", F.lit(0)) / 1_000_000 * rate[1]


def usage_rollup(calls: DataFrame, rates: dict[str, tuple[float, float]], default: str) -> DataFrame:
    """Tokens in and out, requests and cost by run, stage and model with subtotals; calls without a reply are counted apart."""
    priced = calls.withColumn("__cost", call_cost(rates, default))
    return priced.rollup("run_id", "stage", "model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count("*").alias("requests"), F.count_if(F.col("error").isNotNull()).alias("unanswered"), F.round(F.sum(F.col("__cost").cast("decimal(20,10)")), 6).cast("double").alias("cost_usd"))


def error_frequency(logs: DataFrame, now: Column, hours: int = 1, pattern: str = "ERROR|CRITICAL|Exception") -> DataFrame:
    """(line, n) of the lines (ts, line) of the last hours before ``now`` that report an error."""
    recent = (F.col("ts") > now - F.make_interval(hours=F.lit(hours))) & (F.col("ts") <= now)
    return logs.where(recent & F.col("line").rlike(pattern)).groupBy("line").agg(F.count("*").alias("n"))


def ranked(df: DataFrame, group: str, by: str, tie: str, most: int | None = None) -> DataFrame:
    """``rank`` within the group by falling ``by``, ties by rising ``tie``; at most ``most`` of each: longest or newest first."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(by), tie)))
    return out if most is None else out.where(F.col("rank") <= most)


def budget_windows(usage: DataFrame, width: str = "1 minute", token_limit: int = 20_000, request_limit: int = 60) -> DataFrame:
    """Tokens and requests of each tumbling window, and whether either limit is passed."""
    sums = usage.groupBy(F.window("ts", width).alias("w")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("requests"))
    return sums.select(F.col("w.start").alias("start"), "tokens", "requests", ((F.col("tokens") > token_limit) | (F.col("requests") > request_limit)).alias("over"))


def admit_requests(usage: DataFrame, width: str = "1 minute", token_limit: int = 20_000, request_limit: int = 60) -> DataFrame:
    """In order within each window a request is admitted if it keeps within both limits; a refused one uses nothing."""

    def admitted(rows):
        key = used = n = None
        for task_id, window, _, event_id, tokens in rows:
            if key != (task_id, window):
                key, used, n = (task_id, window), 0, 0
            ok = used + tokens <= token_limit and n + 1 <= request_limit
            if ok:
                used, n = used + tokens, n + 1
            yield task_id, event_id, ok

    rows = usage.select("task_id", F.unix_micros(F.window("ts", width)["start"]).alias("window"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id", "tokens")
    schema = StructType([rows.schema["task_id"], rows.schema["event_id"], StructField("admitted", BooleanType())])
    return ordered_pass(rows, ["task_id", "window"], ["t", "event_id"], admitted, schema)


def route_limits(requests: DataFrame, width: str = "1 hour", slide: str = "1 minute", limit: int = 100) -> DataFrame:
    """Sliding windows of a key that hold more requests than the limit."""
    counts = requests.groupBy("task_id", F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("requests"))
    return counts.where(F.col("requests") > limit).select("task_id", F.col("w.start").alias("start"), "requests")


def route_budgets(requests: DataFrame, limits: dict[str, int], slide: str = "1 minute", exempt: list[str] = (), route_col: str = "route") -> DataFrame:
    """(width, task_id, start, requests): windows of each width that pass their limit; requests of exempt routes don't count."""
    counted = requests.where(~F.coalesce(F.col(route_col).isin(*exempt), F.lit(False))) if exempt else requests
    found = [route_limits(counted, width, slide, limit).withColumn("width", F.lit(width)) for width, limit in limits.items()]
    return functools.reduce(DataFrame.unionByName, found)
