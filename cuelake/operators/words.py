"""Words to cues: sentences, speaker turns, length splits, safe merges, lead-out.

Sentences and turns are windows by ``video_id``; all that follows is one pass over the words in order without
another shuffle, linear, with one part and one group carried along.  Each step also stands by itself.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import namedtuple
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from cuelake.functions.timedtext import CUE_LINES, DASH, DEGENERATE_MS, LEAD_OUT_MS, LINE_CHARS, MAX_CUE_MS, MERGE_GAP_MS, MIN_CUE_MS, MIN_GAP_MS, MIN_VISIBLE_MS, PAUSE_MS, TURN_GAP_MS, is_terminal
from cuelake.operators.passes import ROWS_OUT, ordered_pass

MAX_CHARS = LINE_CHARS * CUE_LINES
BEFORE = (Window.unboundedPreceding, -1)


def _video():
    return Window.partitionBy("video_id")


def _running(flag: Column, order: Window, rows=(Window.unboundedPreceding, 0)) -> Column:
    return F.coalesce(F.sum(flag.cast("int")).over(order.rowsBetween(*rows)), F.lit(0))


def clean_words(raw: DataFrame) -> DataFrame:
    """Words of either spelling (s, e, w or start, end, word; seconds as text or numbers) to (video_id, pos, s_ms, e_ms, w).

    Blank words and those without a usable time go; times are clamped at 0 and ends at their starts.
    """
    have = set(raw.columns)

    def first(*names: str) -> Column:
        return F.coalesce(*(F.col(n).cast("string") for n in names if n in have), F.lit(None).cast("string"))

    text = F.trim(F.coalesce(first("w", "word"), F.lit("")))
    start, end = first("s", "start").try_cast("double"), F.coalesce(first("e", "end"), first("s", "start")).try_cast("double")
    ok = raw.select("video_id", "pos", text.alias("w"), start.alias("s"), end.alias("e")).where("w <> ''")
    # neither null nor infinite nor NaN, which is above all numbers: asked once, since Spark puts what a column is made of into each condition on it
    inf = F.lit(float("inf"))
    ms = ok.where((F.abs("s") < inf) & (F.abs("e") < inf)).withColumn("s_ms", F.greatest(F.lit(0), F.bround(F.col("s") * 1000)).cast("bigint")).withColumn("e_ms", F.greatest(F.col("s_ms"), F.bround(F.col("e") * 1000).cast("bigint")))
    return ms.select("video_id", (F.row_number().over(_video().orderBy("s_ms", "pos")) - 1).alias("pos"), "s_ms", "e_ms", "w")


def _marked(words: DataFrame, *more: Column) -> DataFrame:
    """``words`` with what sentences depend on, and columns of other windows."""
    order = _video().orderBy("s_ms", "pos")
    # windows over whole videos take the order of the others, so that all are one step and words are sorted once
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    timed = words.withColumn("__t", is_terminal(F.col("w"))).withColumn("__closes", F.col("__t") & (F.col("e_ms") - F.col("s_ms") >= DEGENERATE_MS))
    return timed.select("*", (F.lead("s_ms").over(order) - F.col("e_ms")).alias("__pause"), F.count("*").over(whole).alias("__n"), F.max("__t").over(whole).alias("__terminals"), *more)


def _ends(closes: str, pause: str) -> Column:
    """Whether a sentence ends between two words of ``_marked``: the first ``closes``, or a video without terminals has a ``pause`` there."""
    return F.col(closes) | ((F.col("__n") >= 8) & ~F.col("__terminals") & F.coalesce(F.col(pause) >= PAUSE_MS, F.lit(False)))


def sentence_groups(words: DataFrame) -> DataFrame:
    """``words`` with sent_id from 0: a group ends after a terminal word of at least 50 ms.

    In a video of eight words or more without any terminal, it ends before a pause of 350 ms.
    """
    marked = _marked(words).withColumn("__end", _ends("__closes", "__pause"))
    return marked.withColumn("sent_id", _running(F.col("__end"), _video().orderBy("s_ms", "pos"), BEFORE)).drop("__t", "__closes", "__n", "__terminals", "__pause", "__end")


def sentence_spans(words: DataFrame) -> DataFrame:
    """The groups of ``sentence_groups`` without their words: (video_id, cue_id from 1, start_ms, end_ms, first_pos, last_pos, chars).

    ``chars`` is the length of the text.  A word knows by its neighbours whether it is the first or last of its group, so one step
    looks at all words, which are not collected, and what follows at those at the edges.
    """
    order = _video().orderBy("s_ms", "pos")
    size = F.coalesce(F.length("w") + 1, F.lit(0))
    marked = _marked(
        words.withColumn("__size", size),
        F.row_number().over(order).alias("__i"),
        F.lag("__closes").over(order).alias("__closed"),
        (F.col("s_ms") - F.lag("e_ms").over(order)).alias("__paused"),
        F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("__upto"),
    )
    head = (F.col("__i") == 1) | F.coalesce(_ends("__closed", "__paused"), F.lit(False))
    tail = (F.col("__i") == F.col("__n")) | F.coalesce(_ends("__closes", "__pause"), F.lit(False))
    edges = marked.select("video_id", "pos", "s_ms", "e_ms", "__upto", "__size", head.alias("__head"), tail.alias("__tail")).where("__head or __tail")
    # a group's rows are now its first and its last word, which may be one
    last = lambda name: F.when(F.col("__tail"), F.col(name)).otherwise(F.lead(name).over(order))
    spans = edges.select("*", _running(F.col("__head"), order).alias("cue_id"), last("e_ms").alias("__end"), last("pos").alias("last_pos"), last("__upto").alias("__whole")).where("__head")
    chars = F.greatest(F.lit(0), F.col("__whole") - F.col("__upto") + F.col("__size") - 1).cast("int")
    return spans.select("video_id", "cue_id", F.col("s_ms").alias("start_ms"), F.greatest("__end", "s_ms").alias("end_ms"), F.col("pos").alias("first_pos"), "last_pos", chars.alias("chars"))


def texts_of(spans: DataFrame, transcripts: DataFrame) -> DataFrame:
    """``spans`` with text, cut from ``transcripts`` (video_id, said), which has each video once, with the word of position k as item k."""
    first = F.col("first_pos").cast("int")
    said = F.slice("said", first + 1, F.col("last_pos").cast("int") - first + 1)
    return spans.join(transcripts.select("video_id", "said"), "video_id").withColumn("text", F.array_join(said, " ")).drop("said")


def turn_groups(sentences: DataFrame) -> DataFrame:
    """With part_id (from 0 in the video), turn and dash: a sentence is parted at silences of 700 ms or more.

    Each later part opens a turn; a part that ends in ``?`` and the one after it carry the dash.
    """
    order = _video().orderBy("s_ms", "pos")  # of all windows but the last, as sentences and parts are runs of words
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    asks = F.coalesce(F.col("w").endswith("?"), F.lit(False))
    before = sentences.select("*", F.lag("e_ms").over(order).alias("__e"), F.lag("sent_id").over(order).alias("__s"), F.coalesce(F.lag(asks).over(order), F.lit(False)).alias("__asked"))
    head = F.coalesce(F.col("__s") != F.col("sent_id"), F.lit(True))
    opened = before.withColumn("__head", head).withColumn("__opens", ~F.col("__head") & F.coalesce(F.col("s_ms") - F.col("__e") >= TURN_GAP_MS, F.lit(False)))
    starts = F.col("__head") | F.col("__opens")
    parts = opened.select(
        *sentences.columns,
        (_running(starts, order) - 1).alias("part_id"),
        F.last(F.when(starts, F.col("__opens")), True).over(so_far).alias("turn"),
        F.last(F.when(starts, F.col("__opens") & F.col("__asked")), True).over(so_far).alias("__after"),
        (asks & F.coalesce(F.lead("__opens").over(order), F.lit(False))).alias("__before"),
    )
    opens_dash = F.max("__before").over(Window.partitionBy("video_id", "part_id").orderBy("s_ms", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return parts.withColumn("dash", opens_dash | F.col("__after")).drop("__after", "__before")


def cuts(ends: list[int], commas: list[int], opening: int, max_chars: int) -> list[tuple[int, str]]:
    """(first word, path of halves) of each piece of a part; ``ends`` are running sums of characters with a space each."""
    out, stack = [], [(0, len(ends), "")]
    while stack:
        low, high, path = stack.pop()
        n = high - low
        chars = ends[high - 1] - (ends[low - 1] if low else -opening) - 1
        if n < 2 or chars <= max_chars:
            out.append((low, path))
            continue
        middle = low + n // 2
        k = bisect_right(commas, middle)
        near = [c for c in commas[max(0, k - 1) : k + 1] if low <= c < high - 1]
        at = min(near, key=lambda c: (abs(c - middle), c)) + 1 if near else middle
        at = max(low + 1, min(at, high - 1))
        stack += [(at, high, path + "b"), (low, at, path + "a")]
    return out


def split_long(parts: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """With group_id: parts over ``max_chars`` are halved at the comma nearest their middle word (the first on ties),
    or at the middle, until none is; a single word stays.

    One pass over the words of a video in order; only the words of the last part are carried from batch to batch.
    """
    sized = parts.withColumn("__n", F.length("w") + 1).withColumn("__comma", F.col("w").endswith(","))
    ordered = sized.repartition("video_id").sortWithinPartitions("video_id", "s_ms", "pos")
    video, part, dash, size, comma = (ordered.columns.index(x) for x in ("video_id", "part_id", "dash", "__n", "__comma"))

    def named(t: pa.RecordBatch) -> pa.RecordBatch:
        ids = t.column(part).to_numpy()
        videos = t.column(video).dictionary_encode().indices.fill_null(-1).to_numpy()
        opens = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (videos[1:] != videos[:-1])]))
        sizes, commas, dashes = (t.column(k).to_numpy(zero_copy_only=False) for k in (size, comma, dash))
        stops = np.append(opens[1:], len(ids))
        names = ids.astype(str).astype(object)
        opening = np.where(dashes[opens], len(DASH), 0)
        for k in np.flatnonzero(np.add.reduceat(sizes, opens) - 1 + opening > max_chars):
            p, q = opens[k], stops[k]
            found = cuts(np.cumsum(sizes[p:q]).tolist(), np.flatnonzero(commas[p:q]).tolist(), int(opening[k]), max_chars)
            for (low, path), high in zip(found, [x for x, _ in found[1:]] + [q - p], strict=True):
                names[p + low : p + high] += path
        return pa.RecordBatch.from_arrays([*t.columns[:-2], pa.array(names, pa.string())], names=[*t.schema.names[:-2], "group_id"])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            ids, videos = b.column(part), b.column(video)
            last = b.num_rows - 1
            first = last
            while first and ids[first - 1] == ids[last] and videos[first - 1] == videos[last]:
                first -= 1
            held = b.slice(first)
            if first:
                yield named(b.slice(0, first))
        if held is not None:
            yield named(held)

    return ordered.mapInArrow(run, parts.withColumn("group_id", F.lit("")).schema)


def group_summaries(words: DataFrame) -> DataFrame:
    """One row a group_id: start, end, chars (with its dash), sentences, ends_q, turn, dash, first and last position."""
    first_of_part = F.min("pos").over(Window.partitionBy("video_id", "part_id"))
    rows = words.withColumn("__open", F.col("pos") == first_of_part)
    out = rows.groupBy("video_id", "group_id").agg(
        F.min("s_ms").alias("start_ms"),
        F.max_by("e_ms", F.struct("s_ms", "pos")).alias("end_ms"),
        (F.sum(F.length("w") + 1) - 1).cast("int").alias("chars"),
        F.sum(is_terminal(F.col("w")).cast("int")).cast("int").alias("sentences"),
        F.max_by(F.col("w").endswith("?"), F.struct("s_ms", "pos")).alias("ends_q"),
        F.max(F.col("turn") & F.col("__open")).alias("turn"),
        F.max(F.col("dash") & F.col("__open")).alias("dash"),
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
    )
    return out.withColumn("chars", F.col("chars") + F.when(F.col("dash"), len(DASH)).otherwise(0))


_FIELDS = ("video_id", "start_ms", "end_ms", "chars", "sentences", "ends_q", "turn", "dash", "first_pos", "last_pos", "compromise")
Group = namedtuple("Group", _FIELDS)


def can_merge(prev: Group, g: Group, max_chars: int) -> bool:
    """Whether a group may join the one before: size, duration, silence, no question before it, no turn, one sentence so far."""
    return (
        prev.chars + 1 + g.chars <= max_chars
        and g.end_ms - prev.start_ms <= MAX_CUE_MS
        and g.start_ms - prev.end_ms <= min(MERGE_GAP_MS, TURN_GAP_MS)
        and not prev.ends_q
        and not g.turn
        and prev.sentences < 2
    )


Piece = namedtuple("Piece", (*_FIELDS, "texts", "durations"))  # a group with its words


def _join(prev: Group | Piece, g: Group | Piece) -> Group | Piece:
    chars = prev.chars + 1 + g.chars - (len(DASH) if g.dash else 0)
    if isinstance(prev, Piece):  # lists that belong to the group alone
        prev.texts.extend(g.texts)
        prev.durations.extend(g.durations)
    return prev._replace(end_ms=g.end_ms, chars=chars, sentences=prev.sentences + g.sentences, ends_q=g.ends_q, last_pos=g.last_pos)


def fold(groups: Iterator[Group], merges, crowds=None) -> Iterator[Group]:
    """Groups in order, each joined to the last kept one of its video where ``merges(last, group)``.

    A kept group that the next one ``crowds`` is a compromise.
    """
    last = None
    for g in groups:
        if last is not None and last.video_id == g.video_id:
            if merges(last, g):
                last = _join(last, g)
                continue
            if crowds is not None and crowds(last, g):
                last = last._replace(compromise=True)
        if last is not None:
            yield last
        last = g
    if last is not None:
        yield last


def _folded(groups: DataFrame, rules: list[tuple]) -> DataFrame:
    """Groups after one fold for each rule, all in one pass over a video's groups in order."""
    flagged = groups if "compromise" in groups.columns else groups.withColumn("compromise", F.lit(False))
    rows = flagged.select(*_FIELDS)

    def rule(tuples):
        out = map(Group._make, tuples)
        for x in rules:
            out = fold(out, *x)
        return out

    return ordered_pass(rows, ["video_id"], ["start_ms", "first_pos"], rule, rows.schema)


def _short(max_chars: int) -> tuple:
    return (lambda p, g: g.end_ms - g.start_ms < MIN_CUE_MS and can_merge(p, g, max_chars),)


def _instant() -> tuple:
    return (lambda p, g: g.start_ms - p.start_ms < MIN_VISIBLE_MS,)


def _floor(max_chars: int) -> tuple:
    crowds = lambda p, g: g.start_ms - p.start_ms < MIN_CUE_MS
    return (lambda p, g: crowds(p, g) and can_merge(p, g, max_chars), crowds)


def merge_short(groups: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """A group under 1.2 s joins the one before where that is safe."""
    return _folded(groups, [_short(max_chars)])


def merge_same_instant(groups: DataFrame) -> DataFrame:
    """A group that starts under 40 ms after the start of the one before joins it."""
    return _folded(groups, [_instant()])


def enforce_min_duration(groups: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """A group that starts under 1.2 s after the one before joins it where that is safe; else that one is a ``compromise``."""
    return _folded(groups, [_floor(max_chars)])


def merge_groups(groups: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """The three merges in order, in one pass."""
    return _folded(groups, [_short(max_chars), _instant(), _floor(max_chars)])


def attach_words(words: DataFrame, groups: DataFrame) -> DataFrame:
    """``words`` with cue_id from 1: the number of the group whose span of positions holds it."""
    opens = groups.select("video_id", F.col("first_pos").alias("pos"), F.lit(1).alias("__opens"), F.col("dash").alias("__dash"), F.col("compromise").alias("__compromise"))
    return words.drop("dash").join(opens, ["video_id", "pos"], "left").withColumn("cue_id", _running(F.col("__opens").isNotNull(), _video().orderBy("s_ms", "pos")))


def word_stats(words: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: words, degenerate (under 50 ms), degenerate_run (the longest in a row), min_word_dur_ms."""
    own = Window.partitionBy(*keys)
    order = own.orderBy("s_ms", "pos")
    short = (F.col("e_ms") - F.col("s_ms")) < DEGENERATE_MS
    marked = words.withColumn("__short", short).withColumn("__island", F.row_number().over(order) - _running(F.col("__short"), order))
    runs = marked.groupBy(*keys, "__island").agg(F.count("*").alias("n"), F.sum(F.col("__short").cast("int")).alias("d"), F.min(F.col("e_ms") - F.col("s_ms")).alias("m"))
    return runs.groupBy(*keys).agg(F.sum("n").alias("words"), F.sum("d").alias("degenerate"), F.max("d").alias("degenerate_run"), F.min("m").alias("min_word_dur_ms"))


def lead_out(cues: DataFrame) -> DataFrame:
    """End times: grown by at most 1 s into silence, shrunk before the next cue but not under 1.2 s, never past its start."""
    nxt = F.lead("start_ms").over(_video().orderBy("start_ms", "cue_id"))
    df = cues.withColumn("__next", nxt)
    limit = F.coalesce(F.least(F.col("__next") - MIN_GAP_MS, F.col("end_ms") + LEAD_OUT_MS), F.col("end_ms") + LEAD_OUT_MS)
    first = F.when(limit < F.col("end_ms"), F.greatest(limit, F.col("start_ms") + MIN_CUE_MS)).otherwise(F.least(limit, F.col("start_ms") + MAX_CUE_MS))
    floor = F.col("start_ms") + MIN_CUE_MS
    floored = F.when(first < floor, floor).otherwise(first)
    bounded = F.least(floored, F.coalesce(F.col("__next"), floored))
    return df.withColumn("end_ms", F.greatest(bounded, F.col("start_ms") + MIN_VISIBLE_MS)).drop("__next")


def clamp_to_end(cues: DataFrame, videos: DataFrame) -> DataFrame:
    """No cue ends after its video, but each lasts 40 ms; videos without a positive duration don't clamp."""
    ends = videos.select("video_id", F.col("duration_ms").alias("__eof"))
    eof = F.when(F.col("__eof") > 0, F.col("__eof"))
    out = F.when(F.col("end_ms") > eof, F.greatest(eof, F.col("start_ms") + MIN_VISIBLE_MS)).otherwise(F.col("end_ms"))
    return cues.join(ends, "video_id", "left").withColumn("end_ms", out).drop("__eof")


def cues_of(words: DataFrame, dashed: bool = True) -> DataFrame:
    """One row for each (video_id, cue_id) of words: start_ms, end_ms, text, and word_stats."""
    dash = F.coalesce(F.max("__dash"), F.lit(False)) if dashed else F.lit(False)
    flag = F.coalesce(F.max("__compromise"), F.lit(False)) if dashed else F.lit(False)
    rows = F.array_sort(F.collect_list(F.struct("s_ms", "pos", "e_ms", "w")))
    cues = words.groupBy("video_id", "cue_id").agg(rows.alias("__rows"), dash.alias("__dash"), flag.alias("compromise"))
    start, end = F.col("__rows")[0]["s_ms"], F.element_at("__rows", -1)["e_ms"]
    text = F.concat(F.when(F.col("__dash"), DASH).otherwise(""), F.array_join(F.col("__rows.w"), " "))
    lasting = F.transform("__rows", lambda x: x["e_ms"] - x["s_ms"])
    longest = F.aggregate(
        lasting,
        F.struct(F.lit(0).cast("bigint").alias("now"), F.lit(0).cast("bigint").alias("most")),
        lambda r, d: F.struct(F.when(d < DEGENERATE_MS, r["now"] + 1).otherwise(0).alias("now"), F.greatest(r["most"], F.when(d < DEGENERATE_MS, r["now"] + 1).otherwise(0)).alias("most")),
    )["most"]
    return cues.select(
        "video_id", "cue_id", start.alias("start_ms"), F.greatest(end, start).alias("end_ms"), text.alias("text"), "compromise",
        F.size("__rows").cast("bigint").alias("words"), F.size(F.filter(lasting, lambda d: d < DEGENERATE_MS)).cast("bigint").alias("degenerate"), longest.alias("degenerate_run"), F.array_min(lasting).alias("min_word_dur_ms"),
    )


def _pieces(batches: Iterator[pa.RecordBatch], max_chars: int) -> Iterator[Group | Piece]:
    """The groups after the length split, from words in order, with their words if those are there; only the words of the last part are carried from batch to batch."""
    held = None
    for b in (*_nonempty(batches), None):
        if b is None:
            if held is None:
                return
            whole, end = held, held.num_rows
        else:
            whole = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            end = None
        video, part, pos, s, e, length, comma, asks, turn, dash, closes, *text = whole.columns
        ids, names = part.to_numpy(), video.dictionary_encode().indices.fill_null(-1).to_numpy()
        opens = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (names[1:] != names[:-1])]))
        if end is None:
            end = int(opens[-1])
            held, opens = whole.slice(end), opens[:-1]
        if not end:
            continue
        sizes = length.to_numpy()[:end].astype(np.int64) + 1
        turns, dashes, terminal, commas, questions = (c.to_numpy(zero_copy_only=False)[:end] for c in (turn, dash, closes, comma, asks))
        starts, ends, stops = s.to_numpy()[:end], e.to_numpy()[:end], np.append(opens[1:], end)
        opening = np.where(dashes[opens], len(DASH), 0)
        first = [opens]
        for k in np.flatnonzero(np.add.reduceat(sizes, opens) - 1 + opening > max_chars).tolist():
            p, q = opens[k], stops[k]
            found = cuts(np.cumsum(sizes[p:q]).tolist(), np.flatnonzero(commas[p:q]).tolist(), int(opening[k]), max_chars)
            first.append(p + np.array([low for low, _ in found[1:]], np.int64))
        at = np.sort(np.concatenate(first))
        upto = np.append(at[1:], end)
        whole_part = np.isin(at, opens)  # turn and dash belong to the first group of a part
        own_dash = dashes[at] & whole_part
        chars = np.add.reduceat(sizes, at) - 1 + np.where(own_dash, len(DASH), 0)
        counted = np.add.reduceat(terminal.astype(np.int64), at)
        places, videos = pos.to_numpy()[:end], video.slice(0, end).take(pa.array(at)).to_pylist()
        columns = (starts[at], ends[upto - 1], chars, counted, questions[upto - 1], turns[at] & whole_part, own_dash, places[at], places[upto - 1])
        groups = zip(videos, *(c.tolist() for c in columns), repeat(False))
        if not text:
            yield from map(Group._make, groups)
            continue
        lasting, texts = (ends - starts).tolist(), text[0].slice(0, end).to_pylist()
        for g, p, q in zip(groups, at.tolist(), upto.tolist(), strict=True):
            yield Piece(*g, texts[p:q], lasting[p:q])


def _nonempty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)


def _led_out(start: int, end: int, after: int | None) -> int:
    """``lead_out`` of one cue before one that starts at ``after``."""
    limit = end + LEAD_OUT_MS if after is None else min(after - MIN_GAP_MS, end + LEAD_OUT_MS)
    grown = max(limit, start + MIN_CUE_MS) if limit < end else min(limit, start + MAX_CUE_MS)
    floored = max(grown, start + MIN_CUE_MS)
    return max(floored if after is None else min(floored, after), start + MIN_VISIBLE_MS)


def _finished(pieces: Iterator[Piece]) -> Iterator[tuple]:
    """Rows of cues with their word statistics, each once the next cue's start is known."""

    def row(p: Piece, number: int, after: int | None) -> tuple:
        run = longest = short = 0
        for d in p.durations:
            run = run + 1 if d < DEGENERATE_MS else 0
            short += run > 0
            longest = max(longest, run)
        end = _led_out(p.start_ms, max(p.end_ms, p.start_ms), after)
        return p.video_id, number, p.start_ms, end, (DASH if p.dash else "") + " ".join(p.texts), p.compromise, len(p.texts), short, longest, min(p.durations)

    last, number = None, 0
    for p in pieces:
        same = last is not None and last.video_id == p.video_id
        if last is not None:
            yield row(last, number, p.start_ms if same else None)
        last, number = p, number + 1 if same else 1
    if last is not None:
        yield row(last, number, None)


_CUES = "cue_id bigint, start_ms bigint, end_ms bigint, text string, compromise boolean, words bigint, degenerate bigint, degenerate_run bigint, min_word_dur_ms bigint"


def cues_in_one_pass(parts: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Length split, the three merges, word statistics and lead-out of ``turn_groups``, in one pass over a video's words in order.

    The windows behind ``parts`` have dealt the words by video, so nothing is shuffled here; a part and a group are held at a time.
    """
    schema = StructType([parts.schema["video_id"], *StructType.fromDDL(_CUES).fields])
    return _in_one_pass(parts, [_short(max_chars), _instant(), _floor(max_chars)], _finished, schema, max_chars, True)


def groups_in_one_pass(parts: DataFrame, merges: tuple[str, ...] = (), max_chars: int = MAX_CHARS) -> DataFrame:
    """Length split and some of the merges (``short``, ``instant``, ``floor``) of ``turn_groups``, in one pass like ``cues_in_one_pass``.

    The rows are those of ``split_long``, ``group_summaries`` and the merges one after another.
    """
    known = {"short": _short(max_chars), "instant": _instant(), "floor": _floor(max_chars)}
    pos = parts.schema["pos"].dataType.simpleString()
    rest = f"start_ms bigint, end_ms bigint, chars int, sentences int, ends_q boolean, turn boolean, dash boolean, first_pos {pos}, last_pos {pos}, compromise boolean"
    schema = StructType([parts.schema["video_id"], *StructType.fromDDL(rest).fields])
    return _in_one_pass(parts, [known[m] for m in merges], lambda pieces: (p[: len(_FIELDS)] for p in pieces), schema, max_chars)


def _in_one_pass(parts: DataFrame, rules: list[tuple], finished, schema: StructType, max_chars: int, worded: bool = False) -> DataFrame:
    """``worded``: the groups have their words, which come into the pass only then."""
    w = F.col("w")
    needed = parts.select("video_id", "part_id", "pos", "s_ms", "e_ms", F.length(w).alias("length"), w.endswith(",").alias("comma"), w.endswith("?").alias("asks"), "turn", "dash", is_terminal(w).alias("closes"), *(["w"] if worded else []))
    rows = needed.sortWithinPartitions("video_id", "part_id", "s_ms", "pos")  # the order of ``turn_groups``, so nothing is sorted again
    out = to_arrow_schema(schema)

    def run(batches):
        pieces: Iterator[Piece] = _pieces(batches, max_chars)
        for rule in rules:
            pieces = fold(pieces, *rule)
        made = finished(pieces)
        while some := list(islice(made, ROWS_OUT)):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some, strict=True), out, strict=True)], schema=out)

    return rows.mapInArrow(run, schema)


def spot_cues(words: DataFrame, videos: DataFrame | None = None, max_chars: int = MAX_CHARS) -> DataFrame:
    """Words to timed cues: every step in order, then lead-out and the video's end.

    Words are shuffled once, by video.  A video's words are in order in one task, so its length in words bounds what is sorted there;
    that is meant for videos up to some millions of words.
    """
    cues = cues_in_one_pass(turn_groups(sentence_groups(words)), max_chars)
    return cues if videos is None else clamp_to_end(cues, videos)
