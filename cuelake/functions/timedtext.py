"""Column expressions shared by the operators.  Times are bigint milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The limits that results must share.
MIN_CUE_MS, MAX_CUE_MS, MIN_GAP_MS, LEAD_OUT_MS, MIN_VISIBLE_MS = 1200, 6000, 80, 1000, 40
PAUSE_MS, MERGE_GAP_MS, TURN_GAP_MS, DEGENERATE_MS, DEGENERATE_RUN = 350, 1000, 700, 50, 3
LINE_CHARS, CUE_LINES, MIN_LINE_CHARS, READING_CPS, SOFT_CPS, HARD_CPS = 42, 2, 8, 17, 35, 90
ENERGY_VETO_DB, CHUNK, MIN_TAIL, OVERLAP, MIN_BUDGET = -6.0, 40, 10, 3, 20
TERMINAL = r"""[.!?]["'”’)\]]*$"""
DASH = "— "


def words_in(text: Column) -> Column:
    """The words of a text; white space of any length parts them."""
    return F.split(F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " ")), " ")


def is_terminal(word: Column) -> Column:
    return word.rlike(TERMINAL)


def folded(text: Column) -> Column:
    """Case- and punctuation-free form for comparing wording: letters, digits, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def clock_srt(ms: Column) -> Column:
    """HH:MM:SS,mmm"""
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def clock_ass(ms: Column) -> Column:
    """H:MM:SS.CC, rounded to hundredths."""
    cs = F.bround(ms / 10).cast("bigint")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def clock_seconds(text: Column) -> Column:
    """Seconds of MM:SS or HH:MM:SS (also plain SS); null if a part isn't a number."""
    return F.aggregate(F.transform(F.split(text, ":"), lambda x: x.try_cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s * 60 + x)
