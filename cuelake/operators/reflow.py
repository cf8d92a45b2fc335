"""Dangling connectors, batches by count and by estimated tokens, and candidate choice."""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from cuelake.functions.timedtext import DASH
from cuelake.operators.passes import ordered_pass

# The bound prefixes of Hebrew and the limits of the move.
PREFIXES, MAX_GAP_MS, MAX_CHARS = "ושהבלכמ", 1500, 84


def _order():
    return Window.partitionBy("video_id").orderBy("start_ms", "cue_id")


def reflow_connectors(cues: DataFrame, col: str = "text", max_chars: int = MAX_CHARS) -> DataFrame:
    """A lone prefix letter that ends a cue moves to the next one; adds ``moved``.

    What a cue receives never changes its own ending, so each row decides from itself and the next row.
    """
    text, order = F.rtrim(F.coalesce(F.col(col), F.lit(""))), _order()
    df = cues.withColumn("__text", text).withColumn("__next", F.ltrim(F.lead(F.coalesce(F.col(col), F.lit(""))).over(order))).withColumn("__gap", F.lead("start_ms").over(order) - F.col("end_ms"))
    token = F.regexp_extract("__text", rf"\s([{PREFIXES}]-?)$", 1)
    rest = F.rtrim(F.expr("substring(__text, 1, length(__text) - length(__token))"))
    df = df.withColumn("__token", token)
    hyphen = F.when(~F.col("__token").endswith("-") & F.col("__next").rlike(r"^[\p{IsLatin}0-9]"), "-").otherwise("")
    full = F.concat("__token", hyphen)
    moves = (F.col("__token") != "") & (F.coalesce(F.col("__next"), F.lit("")) != "") & (F.col("__gap") <= MAX_GAP_MS) & (rest != "") & (F.length(F.concat(full, "__next")) <= max_chars)
    df = df.withColumn("moved", F.coalesce(moves, F.lit(False))).withColumn("__gift", F.when(F.col("moved"), full))
    got = F.lag("__gift").over(order)
    own = F.when(F.col("moved"), rest).otherwise(F.col(col))
    out = F.when(got.isNotNull(), F.concat(got, F.ltrim(own))).otherwise(own)
    return df.withColumn(col, out).drop("__text", "__next", "__gap", "__token", "__gift")


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.regexp_count(text, F.lit(r"\S+")) * 13 / 10)


def halves(tokens: list[int], low: int, high: int, limit: int) -> list[int]:
    """Starts of the parts of tokens[low:high], halved while they hold more than one segment and more than the limit."""
    sums = [0, *accumulate(tokens[low:high])]
    out, stack = [], [(low, high)]
    while stack:
        a, b = stack.pop()
        if b - a > 1 and sums[b - low] - sums[a - low] > limit:
            middle = a + (b - a) // 2
            stack += [(middle, b), (a, middle)]
        else:
            out.append(a)
    return out


def _numbers(limit: int):
    """For a list of token numbers, the number of the part that each is in: halved until within the limit."""

    @F.pandas_udf("array<int>")
    def numbers(lists: pd.Series) -> pd.Series:
        out = []
        for own in lists:
            own = [int(x) for x in own]
            starts = halves(own, 0, len(own), limit)
            out.append([k for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(own)], strict=True)) for _ in range(a, b)])
        return pd.Series(out)

    return numbers


def _batched(segments: DataFrame, limit: int, size: int | None) -> DataFrame:
    """With tokens, batch and oversize.  Texts are never gathered; with a size, no more than that many token numbers are in a row."""
    df = segments.withColumn("tokens", estimated_tokens(F.col("text")))
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("pos")) - 1
    bucket = F.floor(number / size) if size else F.lit(0).cast("bigint")
    rows = df.select("video_id", "pos", "tokens", bucket.alias("bucket")).groupBy("video_id", "bucket").agg(F.array_sort(F.collect_list(F.struct("pos", "tokens"))).alias("rows"))
    parts = rows.withColumn("part", _numbers(limit)("rows.tokens"))
    before = F.sum(F.array_max("part") + 1).over(Window.partitionBy("video_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    batch = parts.withColumn("before", F.coalesce(before, F.lit(0))).select("video_id", "before", F.explode(F.arrays_zip(F.col("rows.pos").alias("pos"), F.col("part").alias("part"))).alias("x"))
    named = batch.select("video_id", "x.pos", (F.col("before") + F.col("x.part")).cast("bigint").alias("batch"))
    return df.join(named, ["video_id", "pos"]).withColumn("oversize", F.col("tokens") > limit)


def batch_by_count(segments: DataFrame, size: int = 20, max_tokens: int = 5000) -> DataFrame:
    """``segments`` with tokens, batch and oversize: batches of ``size``, halved while over the token limit."""
    return _batched(segments, max_tokens, size)


def batch_by_tokens(segments: DataFrame, max_tokens: int) -> DataFrame:
    """The whole list of a video is halved until each part is within the limit (or one segment)."""
    return _batched(segments, max_tokens, None)


def choose_candidate(cues: DataFrame) -> DataFrame:
    """Of the legal candidates (array of text and legal) the longest within ``limit``, the first on ties; else the shortest of
    the legal ones and the original.  Adds choice and fits."""
    legal = F.transform(F.filter("candidates", lambda c: c["legal"] & (F.trim(c["text"]) != "")), lambda c: F.trim(c["text"]))
    indexed = lambda a: F.transform(a, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x")))
    fitting = F.array_max(indexed(F.filter(legal, lambda x: F.length(x) <= F.col("limit"))))
    shortest = F.array_min(F.transform(F.concat(legal, F.array("original")), lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("x"))))
    return cues.withColumn("fits", F.coalesce(fitting["n"], shortest["n"]) <= F.col("limit")).withColumn("choice", F.coalesce(fitting["x"], shortest["x"]))


# Marks, and the words that a shortened line may lose, may never lose, or may not end with.
STRIPPED, FINAL_MARKS, CLOSING_MARKS, POINTS = " \t\r\n.,!?;:…\"'()[]{}«»„“”‘’-–—״׳", ".?!…", ".?!…,:;", "[\u0591-\u05c7]"
MAY_GO = tuple("""
    אה אהה אמ המ הא נו ובכן טוב אוקיי אוקי הנה כאילו בעצם פשוט ממש מאוד די לגמרי
    כמובן למעשה בכלל הרי בערך כמעט בעצם אז גם רק עוד כבר הכי יותר פחות כך ככה
    היי הי אוי אויה וואו וואי אופס הופ יאללה אוף
    זה זו זאת הזה הזאת הזו אלה האלה הללו
    היה הייתה היתה היו יהיה תהיה
    אני אתה את הוא היא אנחנו אתם אתן הם הן
    אותי אותך אותו אותה אותנו אותם אותן
    לי לך לו לה לנו להם להן
    מזה בזה לזה כזה לכך בכך מכך
    עליו עליה עליהם ממנו ממנה מהם אליו אליה אליהם בו בה בהם
    ו ש כי אם אבל או אשר כדי של עם על אל מן כן נכון
    uh um er ah oh hey well okay ok like you know i mean so right yeah
    a an the is are was were that this it
""".split())
MUST_STAY = tuple("""
    לא אין בלי ללא לעולם מעולם לאו אינו אינה אינם אינן
    עצמי עצמך עצמו עצמה עצמנו עצמכם עצמכן עצמם עצמן
    not no never none without
""".split())
WEAK_ENDS = tuple("""
    של את עם על אל מן אצל בין מול תחת לפי לגבי בגלל למרות כמו אחרי לפני
    כי אם אבל או אשר כדי כאשר ו ש הכי
    of to in on at by for with from and or but that which the a an
""".split())
CONJUNCTION = "ו"


def compared_words(text: Column) -> Column:
    """Words of a text as they are compared: lower case, without Hebrew points and without marks at either end."""
    bare = lambda w: F.lower(F.regexp_replace(F.btrim(w, F.lit(STRIPPED)), POINTS, ""))
    return F.filter(F.transform(F.split(F.trim(text), r"(?U)\s+"), bare), lambda w: w != "")


def _has(words: Column, word: Column) -> Column:
    """Whether a word is among others, with or without the conjunction in front of either."""
    joined = F.concat(F.lit(CONJUNCTION), word)
    return F.exists(words, lambda w: (w == word) | (w == joined) | (F.concat(F.lit(CONJUNCTION), w) == word))


def condensation_check(df: DataFrame, original: str = "original", candidate: str = "candidate") -> DataFrame:
    """``reason``: the first rule a shortened text breaks, or null.

    In order: it is empty, has no words, lost the dash, ends with another final mark, lost its closing mark, lost the last
    word that says something, lost a number, lost a negation or reflexive, ends on a word that can't end a line.
    """
    o, c = F.trim(F.coalesce(F.col(original), F.lit(""))), F.trim(F.coalesce(F.col(candidate), F.lit("")))
    d = df.withColumn("__o", o).withColumn("__c", c).withColumn("__x", compared_words(F.col("__o"))).withColumn("__y", compared_words(F.col("__c")))
    o, c, x, y = (F.col(k) for k in ("__o", "__c", "__x", "__y"))
    end, own = F.right(o, F.lit(1)), F.right(c, F.lit(1))
    of = lambda mark, marks: (mark != "") & F.lit(marks).contains(mark)
    content = F.element_at(F.filter(x, lambda w: ~w.isin(*MAY_GO)), -1)
    # a column of its own, or it would be found anew for each word it is compared with
    d = d.withColumn("__content", F.when(F.exists(x, lambda w: ~w.isin(*MAY_GO)), content))
    content = F.col("__content")
    # what must stay is looked up in a set of the candidate's words in all their forms, as a long line may hold thousands of numbers
    forms = F.concat(y, F.transform(y, lambda w: F.concat(F.lit(CONJUNCTION), w)), F.transform(F.filter(y, lambda w: w.startswith(CONJUNCTION)), lambda w: F.substr(w, F.lit(len(CONJUNCTION) + 1))))
    d = d.withColumn("__stay", F.filter(x, lambda w: w.isin(*MUST_STAY) | w.rlike(r"\p{Nd}")))
    d = d.withColumn("__lost", F.when(F.size("__stay") > 0, F.get(F.array_except("__stay", forms), F.lit(0))))
    lost = F.col("__lost")
    reason = (
        F.when(c == "", "empty")
        .when(F.size(y) == 0, "no_words")
        .when(o.startswith(DASH) & ~c.startswith(DASH), "lost_dash")
        .when(of(end, FINAL_MARKS) & (own != end) & ~((end == "…") & of(own, FINAL_MARKS)), "changed_mark")
        .when(of(end, CLOSING_MARKS) & ~of(own, CLOSING_MARKS), "lost_mark")
        .when(content.isNotNull() & ~_has(y, content), "lost_content")
        .when(lost.isNotNull(), F.when(lost.rlike(r"\p{Nd}"), "lost_number").otherwise("lost_negation"))
        .when(F.element_at(y, -1).isin(*WEAK_ENDS), "weak_end")
    )
    return d.withColumn("reason", reason).drop("__o", "__c", "__x", "__y", "__content", "__stay", "__lost")


def transfer_speed(transfer: DataFrame, alpha: float = 0.3, min_interval_us: int = 2_000_000) -> DataFrame:
    """Batch form of the moving average: one pass over the samples of each transfer in order.

    A sample under two seconds after the last accepted one, or without growth, is skipped.  With a column ``total_bytes``
    accepted samples also have ``percent`` (to 100) and ``eta_s``, null where the total is unknown.
    """
    sized = "total_bytes" in transfer.columns

    def speeds(rows):
        task = at = size = ema = None
        for task_id, t, event_id, n, total in rows:
            if at is None or task_id != task:
                task, at, size, ema = task_id, t, n, None
            elif t - at >= min_interval_us and n > size:
                speed = (n - size) * 1e6 / (t - at)
                at, size, ema = t, n, speed if ema is None else alpha * speed + (1 - alpha) * ema
                yield task_id, event_id, ema, n, total

    total = F.col("total_bytes").cast("bigint") if sized else F.lit(None).cast("bigint")
    rows = transfer.select("task_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id", F.col("bytes").cast("bigint").alias("bytes"), total.alias("total"))
    schema = StructType([rows.schema["task_id"], rows.schema["event_id"], StructField("speed", DoubleType()), StructField("bytes", LongType()), StructField("total", LongType())])
    out = ordered_pass(rows, ["task_id"], ["t", "event_id"], speeds, schema)
    if not sized:
        return out.drop("bytes", "total")
    known = F.col("total") > 0
    return out.withColumn("percent", F.when(known, F.least(F.lit(100.0), 100.0 * F.col("bytes") / F.col("total")))).withColumn("eta_s", F.when(known, F.greatest(F.lit(0.0), (F.col("total") - F.col("bytes")) / F.col("speed")))).drop("bytes", "total")
