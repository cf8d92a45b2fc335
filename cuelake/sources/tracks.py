"""Subtitle tracks and stamped transcripts: one document a video, and back to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelake.functions.timedtext import clock_ass, clock_seconds, clock_srt
from cuelake.operators.layout import measured_text, video_layout, wrap_lines
from cuelake.operators.text import isolate_bidi, repair_typography


def write_srt(cues: DataFrame, translated: bool = True) -> DataFrame:
    """(video_id, body): numbered, timed blocks; a blank translation falls back to the source text."""
    text = F.regexp_replace(measured_text("translated_text", "text") if translated else F.trim("text"), r"\s*\n\s*", " ")
    block = F.concat(F.col("cue_id").cast("string"), F.lit("\n"), clock_srt(F.col("start_ms")), F.lit(" --> "), clock_srt(F.col("end_ms")), F.lit("\n"), text, F.lit("\n"))
    rows = cues.select("video_id", "cue_id", block.alias("block"))
    return rows.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_id", "block"))), lambda x: x["block"]), "\n").alias("body"))


TIMING = r"(\d+):(\d\d):(\d\d)[,.](\d{3})\s*-->\s*(\d+):(\d\d):(\d\d)[,.](\d{3})"


def read_srt(tracks: DataFrame) -> DataFrame:
    """Cue rows of SRT bodies; blocks without a timing line are left out."""
    blocks = tracks.select("video_id", F.explode(F.split("body", r"\n\s*\n")).alias("block"))
    part = lambda k: F.regexp_extract("block", TIMING, k).try_cast("bigint")
    time = lambda k: ((part(k) * 60 + part(k + 1)) * 60 + part(k + 2)) * 1000 + part(k + 3)
    rows = blocks.select("video_id", F.regexp_extract("block", r"^\s*(\d+)\s*\n", 1).try_cast("int").alias("cue_id"), time(1).alias("start_ms"), time(5).alias("end_ms"), F.trim(F.regexp_replace(F.regexp_replace("block", r"(?s)^.*?-->[^\n]*\n?", ""), r"\s*\n\s*", " ")).alias("text"))
    return rows.where("start_ms is not null")


def srt_plain_text(tracks: DataFrame) -> DataFrame:
    """(video_id, plain): the text lines alone, joined by spaces."""
    keep = lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^\d+$") & ~x.contains("-->")
    return tracks.select("video_id", F.array_join(F.transform(F.filter(F.split("body", "\n"), keep), lambda x: F.trim(x)), " ").alias("plain"))  # F.trim itself would get the index as what to trim


def write_ass_events(cues: DataFrame, rtl: bool = False) -> DataFrame:
    """(video_id, cue_id, line): dialogue rows with braces neutralised and lines joined by ``\\N``; needs ``wrapped``.

    With ``rtl`` each line is isolated right to left.
    """
    plain = cues.withColumn("wrapped", F.translate("wrapped", "{}", "()"))
    shown = isolate_bidi(plain, "wrapped") if rtl else plain
    line = F.concat(F.lit("Dialogue: 0,"), clock_ass(F.col("start_ms")), F.lit(","), clock_ass(F.col("end_ms")), F.lit(",Default,,0,0,0,,"), F.regexp_replace("wrapped", r"\n", r"\\N"))
    return shown.select("video_id", "cue_id", line.alias("line"))


# The header that players read.
SCRIPT = ("[Script Info]", "ScriptType: v4.00+", "PlayResX: %d", "PlayResY: %d", "WrapStyle: 2", "ScaledBorderAndShadow: yes", "")
STYLES = ("[V4+ Styles]", "Format: Name, Fontname, Fontsize, Alignment, MarginL, MarginR, MarginV", "Style: Default,Noto Sans Hebrew,%d,2,%d,%d,%d", "")
EVENTS = ("[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text", "")


def write_ass(cues: DataFrame, videos: DataFrame, rtl: bool = False) -> DataFrame:
    """(video_id, body): a script a video, sized by its own layout: header, then its dialogue rows in order of time.

    Texts have Hebrew typography and are wrapped to the line budget of their video.
    """
    sizes = video_layout(videos).select("video_id", "width", "height", "font_px", "margin_h", "margin_v", "line_chars")
    flat = cues.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))
    wrapped = wrap_lines(repair_typography(flat, "text").join(sizes.select("video_id", "line_chars"), "video_id"), limit=F.col("line_chars"))
    rows = write_ass_events(wrapped, rtl).join(cues.select("video_id", "cue_id", "start_ms"), ["video_id", "cue_id"])
    events = rows.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "cue_id", "line"))), lambda x: x["line"]), "\n").alias("events"))
    header = F.format_string("\n".join(SCRIPT + STYLES + EVENTS), "width", "height", "font_px", "margin_h", "margin_h", "margin_v")
    return events.join(sizes, "video_id").select("video_id", F.concat(header, "events", F.lit("\n")).alias("body"))


#: minutes and seconds, with hours in front where there are any
CLOCK = r"\d{1,2}(?::\d{2}){1,2}"
RANGE = rf"^\[({CLOCK})\s*-\s*({CLOCK})\]\s*(.+)"


def read_ranged_transcripts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, rejects) of lines ``[MM:SS - MM:SS] text``; entries are numbered from 1 in each document."""
    lines = docs.select("video_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    ok = F.col("line").rlike(RANGE)
    at = lambda k: F.regexp_extract("line", RANGE, k)
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("pos"))
    entries = lines.where(ok).select("video_id", number.alias("entry"), clock_seconds(at(1)).alias("start_s"), clock_seconds(at(2)).alias("end_s"), F.trim(at(3)).alias("text"))
    return entries, lines.where(~ok)


#: digits in up to three parts, first and last a digit; clock_seconds decides what they mean
STAMP = r"(?=\d[\d:]*\d\])\d*(?::\d*){0,2}"
MARK = rf"\[({STAMP})\]\s*([^\[]*)"


def read_stamped_transcripts(docs: DataFrame) -> DataFrame:
    """Segments of texts with marks ``[MM:SS] text``: each ends at the next mark, the last 5 s on or with the video.

    A text without a mark is one segment; a blank segment goes, but its mark still ends the one before.
    """
    marks = F.regexp_extract_all("text", F.lit(MARK), 0)
    whole = F.when(~F.col("text").rlike(MARK), F.col("text"))  # not beside each of its marks
    rows = docs.select("video_id", "duration_s", whole.alias("whole"), F.posexplode_outer(marks).alias("pos", "mark"))
    start = clock_seconds(F.regexp_extract("mark", MARK, 1))
    order = Window.partitionBy("video_id").orderBy("pos")
    df = rows.withColumn("start_s", F.when(F.col("mark").isNotNull(), start).otherwise(0)).withColumn("__next", F.lead("start_s").over(order))
    end = F.when(F.col("mark").isNull(), F.col("duration_s")).otherwise(F.coalesce("__next", F.least(F.col("start_s") + 5, F.col("duration_s"))))
    text = F.when(F.col("mark").isNull(), F.trim("whole")).otherwise(F.trim(F.regexp_replace(F.regexp_extract("mark", MARK, 2), r"\s+$", "")))
    return df.select("video_id", F.coalesce("pos", F.lit(0)).alias("pos"), "start_s", end.alias("end_s"), text.alias("text")).where("text <> '' or start_s = 0 and end_s is null")
