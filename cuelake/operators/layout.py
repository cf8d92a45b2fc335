"""Layout of a frame, reading speed, time relief, line wrapping and request planning for cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelake.functions.timedtext import CHUNK, CUE_LINES, LINE_CHARS, MAX_CUE_MS, MIN_BUDGET, MIN_GAP_MS, MIN_LINE_CHARS, MIN_TAIL, OVERLAP, READING_CPS

# Fractions of the frame and the width of a character.
MARGIN_PX, MARGIN_FRACTION, FONT_FRACTION, BOTTOM_FRACTION, FLOOR_FRACTION, GLYPH = 60, 0.15, 0.061, 0.12, 0.032, 0.44


def _order():
    return Window.partitionBy("video_id").orderBy("start_ms", "cue_id")


def video_layout(videos: DataFrame) -> DataFrame:
    """``videos`` with margins, usable width, font size and character budgets; rounding is half to even."""
    w, h = F.greatest(F.lit(1), F.coalesce("width", F.lit(0))), F.greatest(F.lit(1), F.coalesce("height", F.lit(0)))
    rounded = lambda x: F.bround(x, 0).cast("int")
    df = videos.withColumn("margin_h", F.least(F.lit(MARGIN_PX), F.floor(w * MARGIN_FRACTION).cast("int"))).withColumn("margin_v", F.greatest(F.lit(0), rounded(h * F.lit(BOTTOM_FRACTION))))
    df = df.withColumn("usable_w", F.greatest(F.lit(1), w - 2 * F.col("margin_h")))
    by_width = F.floor(F.col("usable_w") / (LINE_CHARS * GLYPH)).cast("int")
    df = df.withColumn("font_px", F.greatest(F.greatest(F.lit(1), rounded(h * F.lit(FLOOR_FRACTION))), F.greatest(F.lit(1), F.least(F.greatest(F.lit(1), rounded(h * F.lit(FONT_FRACTION))), by_width))))
    df = df.withColumn("line_chars", F.greatest(F.lit(MIN_LINE_CHARS), F.least(F.lit(LINE_CHARS), F.floor(F.col("usable_w") / (F.col("font_px") * GLYPH)).cast("int"))))
    return df.withColumn("cue_chars", F.col("line_chars") * CUE_LINES)


def attach_layout(cues: DataFrame, videos: DataFrame, *more: str) -> DataFrame:
    """Each cue with its video's character budgets and ``more`` of its columns; Spark broadcasts the layout where its size allows."""
    return cues.join(video_layout(videos).select("video_id", "line_chars", "cue_chars", *more), "video_id")


def measured_text(*columns: str) -> Column:
    """The first text that isn't blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns), F.lit(""))


def cps_report(cues: DataFrame, *more: str) -> DataFrame:
    """Characters, seconds, characters a second (null without a duration), whether the cue is within its budgets, and ``more`` of its columns.

    Cues that have ``chars``, counted before, need no text.
    """
    chars = F.col("chars") if "chars" in cues.columns else F.length(measured_text("translated_text", "text"))
    ms = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    ok = (chars <= F.col("cue_chars")) & ((ms <= 0) | (chars * 1000 <= READING_CPS * ms))
    return cues.select("video_id", "cue_id", chars.alias("chars"), ms.alias("duration_ms"), F.when(ms > 0, F.round(chars * 1000 / ms, 2)).alias("cps"), ok.alias("ok"), *more)


def budget(ms: Column, cue_chars: Column) -> Column:
    """Characters that can be read in the time and fit the frame."""
    return F.least(cue_chars, F.floor(READING_CPS * ms / 1000))


def time_relief(cues: DataFrame, videos: DataFrame) -> DataFrame:
    """Cues over their reading budget, but within the frame's, are held longer where there is room; adds ``relieved``."""
    df = cues.withColumn("__next", F.lead("start_ms").over(_order())).join(videos.select("video_id", "duration_ms"), "video_id", "left")
    chars, ms = F.length(measured_text("translated_text", "text")), F.col("end_ms") - F.col("start_ms")
    eligible = ~F.col("context_only") & (chars > 0) & (ms > 0) & (chars > budget(ms, F.col("cue_chars"))) & (chars <= F.col("cue_chars"))
    ceiling = F.least(F.col("start_ms") + MAX_CUE_MS, F.coalesce(F.col("__next") - MIN_GAP_MS, F.col("start_ms") + MAX_CUE_MS), F.when(F.col("duration_ms") > 0, F.col("duration_ms")).otherwise(F.col("start_ms") + MAX_CUE_MS))
    held = F.least(F.col("start_ms") + F.floor((chars * 1000 + READING_CPS - 1) / READING_CPS), ceiling)
    better = F.coalesce(eligible & (held > F.col("end_ms")), F.lit(False))
    return df.withColumn("relieved", better).withColumn("end_ms", F.when(better, held).otherwise(F.col("end_ms")).cast("bigint")).drop("__next", "duration_ms")


def condense_worklist(cues: DataFrame, batch: int = CHUNK) -> DataFrame:
    """Cues over 110 % of their budget: limit, floor of 85 %, and the batch (null if too tight to condense)."""
    text = F.trim("translated_text")
    limit = budget(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")), F.col("cue_chars"))
    over = cues.withColumn("chars", F.length(text)).withColumn("limit", limit).where((text != "") & (F.col("chars") * 10 > F.col("limit") * 11))
    tight = F.col("limit") < MIN_BUDGET
    number = F.row_number().over(Window.partitionBy("video_id", tight).orderBy("start_ms", "cue_id"))
    return over.select("video_id", "cue_id", "chars", "limit", F.floor(F.col("limit") * 85 / 100).alias("keep"), tight.alias("too_tight"), F.when(~tight, F.floor((number - 1) / batch)).alias("batch"))


def plan_chunks(cues: DataFrame, chunk: int = CHUNK, min_tail: int = MIN_TAIL, overlap: int = OVERLAP) -> DataFrame:
    """One row a request: chunk, target ids and context ids (neighbours on both sides and context-only rows inside).

    A last chunk under ``min_tail`` cues joins the one before; a chunk without targets is not sent.
    """
    df = cues.withColumn("i", F.row_number().over(_order())).withColumn("n", F.count("*").over(Window.partitionBy("video_id")))
    last = F.ceil(F.col("n") / chunk) - 1
    tail = F.col("n") - last * chunk
    df = df.withColumn("last", F.when((F.col("n") > chunk) & (tail < min_tail), last - 1).otherwise(last).cast("int"))
    df = df.withColumn("own", F.least(F.floor((F.col("i") - 1) / chunk).cast("int"), F.col("last")))
    # neighbours of a chunk: the ``overlap`` rows before its first and after its last
    first = lambda k: k * chunk + 1
    before = F.when((F.col("own") < F.col("last")) & (F.col("i") > first(F.col("own") + 1) - 1 - overlap), F.col("own") + 1)
    after = F.when((F.col("own") > 0) & (F.col("i") < first(F.col("own")) + overlap), F.col("own") - 1)
    dealt = df.withColumn("chunk", F.explode(F.array_compact(F.array(F.col("own"), before, after))))
    has_text = F.trim(F.coalesce("text", F.lit(""))) != ""
    target = has_text & (F.col("chunk") == F.col("own")) & ~F.col("context_only")
    context = has_text & ((F.col("chunk") != F.col("own")) | F.col("context_only"))
    grouped = dealt.groupBy("video_id", "chunk").agg(F.array_sort(F.collect_list(F.when(target, F.col("i")))).alias("target_ids"), F.array_sort(F.collect_list(F.when(context, F.col("i")))).alias("context_ids"))
    return grouped.where(F.size("target_ids") > 0)


def request_bodies(chunks: DataFrame, cues: DataFrame) -> DataFrame:
    """Numbered lines of each request, context marked, and its ids as ``a-b`` where they are contiguous."""
    numbered = cues.withColumn("i", F.row_number().over(_order())).select("video_id", "i", F.trim("text").alias("text"))
    lines = chunks.select("video_id", "chunk", F.explode(F.concat(F.transform("target_ids", lambda x: F.struct(x.alias("i"), F.lit(False).alias("context"))), F.transform("context_ids", lambda x: F.struct(x.alias("i"), F.lit(True).alias("context"))))).alias("x")).select("video_id", "chunk", "x.i", "x.context")
    text = F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] "), F.when(F.col("context"), "(context) ").otherwise(""), "text")
    body = lines.join(numbered, ["video_id", "i"]).groupBy("video_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", text.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    ids = F.when(F.array_max("target_ids") - F.array_min("target_ids") + 1 == F.size("target_ids"), F.concat(F.array_min("target_ids").cast("string"), F.when(F.size("target_ids") > 1, F.concat(F.lit("-"), F.array_max("target_ids").cast("string"))).otherwise(""))).otherwise(F.array_join(F.transform("target_ids", lambda x: x.cast("string")), ","))
    return chunks.join(body, ["video_id", "chunk"]).select("video_id", "chunk", ids.alias("ids"), "body")


def wrap_lines(cues: DataFrame, text_col: str = "text", limit: int | Column = LINE_CHARS) -> DataFrame:
    """``wrapped``: at most two lines, split where the score (imbalance, -30 after a stop, -12 after a comma, +3 top-heavy)
    is least, the first on ties; a text without a fitting split is wrapped greedily."""
    words = F.filter(F.split(F.trim(F.col(text_col)), r"\s+"), lambda x: x != "")
    join = lambda a: F.array_join(a, " ")

    def option(i: Column) -> Column:
        top, bottom = join(F.slice("__w", F.lit(1), i)), join(F.slice("__w", i + 1, F.size("__w")))
        gap = F.length(top) - F.length(bottom)
        score = F.abs(gap) + F.when(gap > 0, 3).otherwise(0) - F.when(top.rlike("[.?!]$"), 30).when(top.rlike("[,;:]$"), 12).otherwise(0)
        return F.struct(score.alias("score"), i.alias("i"), top.alias("top"), bottom.alias("bottom"))

    df = cues.withColumn("__w", words).withColumn("__whole", join(F.col("__w")))
    whole = F.col("__whole")
    long = F.length(whole)
    options = F.when((F.size("__w") > 1) & (long > limit) & (long <= 2 * limit + 1), F.transform(F.sequence(F.lit(1), F.size("__w") - 1), option)).otherwise(F.expr("array()").cast("array<struct<score:int,i:int,top:string,bottom:string>>"))
    df = df.withColumn("__best", F.array_min(F.filter(options, lambda o: (F.length(o["top"]) <= limit) & (F.length(o["bottom"]) <= limit))))
    # greedy: as many words as fit, or one that does not, again and again; a line is looked at once
    line = F.concat(F.lit("(?s)(.{1,"), F.greatest(F.lit(1), limit if isinstance(limit, Column) else F.lit(limit)).cast("string"), F.lit(r"}|[^ ]+)(?: |\z)"))
    lines = F.regexp_replace(whole, line, F.lit("$1\n"))
    hard = F.substring(lines, F.lit(1), F.length(lines) - 1)
    wrapped = F.when(long <= limit, whole).when(F.col("__best").isNotNull(), F.concat("__best.top", F.lit("\n"), "__best.bottom")).otherwise(hard)
    return df.withColumn("wrapped", wrapped).drop("__w", "__whole", "__best")
