"""Decoded bands, page candidates, qualities, glossaries and performance flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EDGE_STEP, BUSY, QUANTILE, MIN_BUSY, MIN_SAMPLES = 24, 0.07, 0.75, 2, 3


def edge_density(bands: DataFrame) -> DataFrame:
    """Per (video_id, sample, band): the share of neighbouring pixels, across and down, that differ by more than a step."""
    keys = ["video_id", "sample", "band"]
    below = F.lead("px").over(Window.partitionBy(*keys).orderBy("row"))
    df = bands.withColumn("__below", below)
    jumps = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y) > EDGE_STEP), lambda x: x))
    across = jumps(F.slice("px", F.lit(1), F.size("px") - 1), F.slice("px", F.lit(2), F.size("px") - 1))
    down = F.when(F.col("__below").isNotNull(), jumps(F.col("px"), F.col("__below"))).otherwise(0)
    pairs = F.size("px") - 1 + F.when(F.col("__below").isNotNull(), F.size("px")).otherwise(0)
    return df.groupBy(*keys).agg((F.sum(across + down) / F.sum(pairs)).alias("score"))


def band_verdict(scores: DataFrame) -> DataFrame:
    """Per video and band: 75th percentile, busy samples, busy; under three samples there is no decision (null)."""
    df = scores.groupBy("video_id", "band").agg(F.count("score").alias("samples"), F.percentile("score", F.lit(QUANTILE)).alias("p"), F.count_if(F.col("score") > BUSY).alias("busy_samples"))
    busy = F.when(F.col("samples") >= MIN_SAMPLES, (F.round("p", 4) > BUSY) | (F.col("busy_samples") >= MIN_BUSY))
    return df.select("video_id", "band", "samples", F.round("p", 4).alias("score"), "busy_samples", busy.alias("busy"))


def resolve_candidates(pages: DataFrame) -> DataFrame:
    """none, single or multiple by the number of a page's entries (array of url, title, duration; null entries don't count), longest first."""
    entries = F.transform(F.filter("entries", lambda e: e.isNotNull()), lambda e: F.struct((-F.coalesce(e["duration"], F.lit(0))).alias("order"), e["url"].alias("url"), F.coalesce(F.nullif(e["title"], F.lit("")), F.lit("Untitled")).alias("title"), e["duration"].alias("duration")))
    df = pages.withColumn("videos", F.array_sort(entries))
    n = F.size("videos")
    return df.withColumn("type", F.when(n == 0, "none").when(n == 1, "single").otherwise("multiple"))


def probe_summary(resolved: DataFrame) -> DataFrame:
    """Counts of pages by what they hold, and the longest duration."""
    return resolved.agg(F.count_if(F.col("type") == "none").alias("none"), F.count_if(F.col("type") == "single").alias("single"), F.count_if(F.col("type") == "multiple").alias("multiple"), F.max(F.array_max(F.transform("videos", lambda v: v["duration"]))).alias("longest"))


def quality_buckets(df: DataFrame) -> DataFrame:
    """``qualities`` of an array of formats (vcodec, height), sorted downwards as text."""
    real = F.filter("formats", lambda f: (f["vcodec"] != "none") & (f["height"] > 0))
    name = lambda f: F.when(f["height"] >= 1080, "1080p").when(f["height"] >= 720, "720p").when(f["height"] >= 480, "480p").otherwise("360p")
    return df.withColumn("qualities", F.sort_array(F.array_distinct(F.transform(real, name)), asc=False))


def normalize_glossary(df: DataFrame, col: str = "glossary", most: int = 40) -> DataFrame:
    """A JSON object of terms to a map of trimmed, non-blank pairs in their order, at most ``most``; what isn't one is empty."""
    entries = F.map_entries(F.from_json(col, "map<string,string>"))
    kept = F.filter(F.transform(entries, lambda e: F.struct(F.trim(e["key"]).alias("key"), F.trim(e["value"]).alias("value"))), lambda e: (e["key"] != "") & (e["value"] != ""))
    return df.withColumn("terms", F.map_from_entries(F.slice(F.coalesce(kept, F.array().cast("array<struct<key:string,value:string>>")), 1, most)))


def safe_description(text) -> Column:
    """The first 200 characters without marks other than plain punctuation, with dots if there was more; null is empty."""
    cut = F.regexp_replace(F.substring(text, 1, 200), r"[^\p{L}\p{N}_\s\p{Z}\-.,!?():]", "")
    return F.coalesce(F.when(F.length(text) > 200, F.concat(cut, F.lit("..."))).otherwise(cut), F.lit(""))


def performance_flags(df: DataFrame) -> DataFrame:
    """Warnings of a job's figures as an array of names, in a fixed order; use of memory and disk in percent may be absent."""
    c = lambda name: F.col(name) if name in df.columns else F.lit(None).cast("double")
    flags = F.array(
        F.when(c("download_mb_s") < 0.5, "download_critical").when(c("download_mb_s") < 2.0, "download_slow"),
        F.when(c("rtf") > 1.0, "slower_than_real_time"), F.when(c("render_ratio") < 2.0, "render_slow"), F.when(c("move_s") > 5.0, "move_slow"),
        F.when(c("cost_usd") >= 0.10, "cost_warning").when(c("cost_usd") >= 0.01, "cost_info"),
        F.when(c("memory_percent") > 85, "memory_high"), F.when(c("disk_percent") > 90, "disk_high"),
    )
    return df.withColumn("flags", F.array_compact(flags))


def normalize_cues(raw: DataFrame) -> DataFrame:
    """Translation is the first text that isn't blank of translated_text and translated; times that don't parse are 0; rows
    blank on both sides go; all other columns stay."""
    both = F.coalesce(F.nullif(F.trim("translated_text"), F.lit("")), F.nullif(F.trim("translated"), F.lit("")), F.lit(""))
    df = raw.withColumn("translated_text", both).withColumn("start", F.coalesce(F.col("start").try_cast("double"), F.lit(0.0))).withColumn("end", F.coalesce(F.col("end").try_cast("double"), F.lit(0.0)))
    return df.where((F.trim(F.coalesce("text", F.lit(""))) != "") | (F.col("translated_text") != "")).drop("translated")
