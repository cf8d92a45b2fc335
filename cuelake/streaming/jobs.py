"""Streaming forms of the statistics, budget and status operators; those that depend on order are in ``stateful``.

State is bounded by watermarks: rows later than the delay are dropped and counted by Spark, and the state of a key
goes once event time has left it behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.operators import jobstats
from cuelake.sources.streams import run_available
from cuelake.streaming import stateful


def budget_windows(usage: DataFrame, width: str = "1 minute", delay: str = "10 minutes", token_limit: int = 20_000, request_limit: int = 60) -> DataFrame:
    """Tokens and requests of each window, in update mode."""
    sums = usage.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("requests"))
    return sums.select(F.col("w.start").alias("start"), "tokens", "requests", ((F.col("tokens") > token_limit) | (F.col("requests") > request_limit)).alias("over"))


def route_limits(requests: DataFrame, width: str = "1 hour", slide: str = "1 minute", delay: str = "10 minutes", limit: int = 100) -> DataFrame:
    """Requests of each key in sliding windows, in update mode, where they pass the limit."""
    counts = requests.withWatermark("ts", delay).groupBy("task_id", F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("requests"))
    return counts.where(F.col("requests") > limit).select("task_id", F.col("w.start").alias("start"), "requests")


def route_budgets(requests: DataFrame, limits: dict[str, int], slide: str = "1 minute", delay: str = "10 minutes", exempt: list[str] = (), route_col: str = "route") -> dict[str, DataFrame]:
    """``route_limits`` for each width, a stream each, as windows of several widths can't share one aggregation; exempt routes don't count."""
    counted = requests.where(~F.coalesce(F.col(route_col).isin(*exempt), F.lit(False))) if exempt else requests
    return {width: route_limits(counted, width, slide, delay, limit) for width, limit in limits.items()}


DAY_MS = 86_400_000


def latest_status(progress: DataFrame, delay: str = "1 day", idle_ms: int = 7 * DAY_MS) -> DataFrame:
    """Newest progress of each task and step whatever the order of arrival, in update mode; an error sticks.

    State is one small row a task and step; it goes after a week without news, by event time.
    """
    rows = progress.select("task_id", "step_index", "ts", "event_id", "progress", F.coalesce(F.col("message") == "error", F.lit(False)).alias("error"))
    newest = stateful.Newest("task_id bigint, step_index int", "event_id bigint, progress bigint, error boolean", idle_ms, sticky=("error",), every=True)
    found = stateful.bucketed(rows, ["task_id", "step_index"], newest, "task_id bigint, step_index int, at bigint, event_id bigint, progress bigint, error boolean", delay, "Update")
    held = F.when(F.col("progress").isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.col("progress")))).cast("bigint")
    status = F.when(F.col("error"), "error").when(held == 0, "waiting").when(held == 100, "completed").otherwise("in_progress")
    return found.select("task_id", "step_index", held.alias("progress"), status.alias("status"))


def daily_summary(stats: DataFrame, base: str | None = None, dates: DataFrame | None = None) -> DataFrame:
    """The batch form's daily summary of all that a stream has brought so far.

    Each micro-batch is added up by date, model and service and put into its own part of a serving table, so a batch that comes
    twice counts once and a late row counts too; the parts are merged on reading.  ``base`` is the folder of table and checkpoint.
    """
    schema = jobstats.daily_partials(stats).schema
    parts = run_available(stats, base=base, each=jobstats.daily_partials, schema=schema)
    return jobstats.days_of(jobstats.merged_days(parts), dates)
