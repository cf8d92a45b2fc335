"""The gate on invented text, the energy veto, and the time that dropped cues free."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelake.functions.timedtext import DEGENERATE_RUN, ENERGY_VETO_DB, HARD_CPS, MAX_CUE_MS, MIN_GAP_MS, SOFT_CPS, folded



def _order():
    return Window.partitionBy("video_id").orderBy("start_ms", "cue_id")


def energy_of(candidates: DataFrame, windows: DataFrame) -> DataFrame:
    """(video_id, cue_id, energy_db): mean level of the windows that overlap a cue, less the mean of the whole video.

    The range join is an equi-join on video and ten-second slots; only the given candidates are measured.
    """
    slot = 10_000
    cues = candidates.select("video_id", "cue_id", "start_ms", "end_ms").withColumn("__slot", F.explode(F.sequence(F.floor(F.col("start_ms") / slot), F.floor((F.col("end_ms") - 1) / slot))))
    heard = windows.withColumn("__slot", F.explode(F.sequence(F.floor(F.col("w_start_ms") / slot), F.floor((F.col("w_end_ms") - 1) / slot))))
    first = F.greatest(F.floor(F.col("start_ms") / slot), F.floor(F.col("w_start_ms") / slot))
    pairs = cues.join(heard, ["video_id", "__slot"]).where((F.col("w_start_ms") < F.col("end_ms")) & (F.col("w_end_ms") > F.col("start_ms")) & (F.col("__slot") == first))
    whole = windows.groupBy("video_id").agg(F.avg("db").alias("base"))
    return pairs.groupBy("video_id", "cue_id").agg(F.avg("db").alias("level")).join(whole, "video_id").select("video_id", "cue_id", F.round(F.col("level") - F.col("base"), 6).alias("energy_db"))


def judge(cues: DataFrame, energy: DataFrame | None = None) -> DataFrame:
    """``cues`` with cps, hard and soft signals, energy_db and dropped.

    A cue is compared with the last one remembered before it: every cue but those dropped on their own
    signals.  A repeat of what is remembered has its form, so leaving it out changes nothing and a
    window over earlier rows gives what a scan in order would.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    length = F.col("end_ms") - F.col("start_ms")
    df = cues.withColumn("__norm", folded(text)).withColumn("__judged", (text != "") & (length > 0))
    df = df.withColumn("cps", F.when(F.col("__judged"), F.length(text) * 1000 / length))
    df = df.withColumn("__fast", F.col("cps") > SOFT_CPS).withColumn("__run", F.coalesce(F.col("degenerate_run"), F.lit(0)) >= DEGENERATE_RUN)
    df = df.withColumn("__impossible", F.coalesce(F.col("cps") > HARD_CPS, F.lit(False)))
    soft2 = F.col("__judged") & F.col("__fast") & F.col("__run")
    if energy is not None:
        df = df.join(energy.select("video_id", "cue_id", F.col("energy_db").alias("__db")), ["video_id", "cue_id"], "left")
    else:
        df = df.withColumn("__db", F.lit(None).cast("double"))
    spared = F.coalesce(F.col("__db") >= ENERGY_VETO_DB, F.lit(False))
    df = df.withColumn("__own", F.col("__judged") & (F.col("__impossible") | (soft2 & ~spared)))
    remembered = F.last(F.when(~F.col("__own"), F.col("__norm")), ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__repeat", F.col("__judged") & (F.col("__norm") != "") & F.coalesce(F.col("__norm") == remembered, F.lit(False)))
    hard = F.array_compact(F.array(F.when(F.col("__impossible"), "cps_impossible"), F.when(F.col("__repeat"), "duplicate_of_previous")))
    soft = F.array_compact(F.array(F.when(F.col("__judged") & F.col("__fast"), "cps_fast"), F.when(F.col("__judged") & F.col("__run"), "degenerate_words")))
    measured = soft2 & ~F.col("__impossible") & ~F.col("__repeat")
    out = df.withColumn("hard", hard).withColumn("soft", soft).withColumn("energy_db", F.when(measured, F.col("__db"))).withColumn("dropped", F.col("__own") | F.col("__repeat"))
    return out.drop("__norm", "__judged", "__fast", "__run", "__impossible", "__db", "__own", "__repeat")


def judged_cues(cues: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """All cues in one table, with ``dropped`` and, for those, signals, context_only and drop_reason; cps is rounded."""
    energy = None
    if windows is not None:
        fast = F.length(F.trim("text")) * 1000 > SOFT_CPS * (F.col("end_ms") - F.col("start_ms"))
        energy = energy_of(cues.where(fast & (F.col("end_ms") > F.col("start_ms")) & (F.col("degenerate_run") >= DEGENERATE_RUN)), windows)
    judged = judge(cues, energy)
    signals = F.concat("hard", "soft")
    reason = F.concat(F.when(F.size("hard") > 0, "hard signal: ").otherwise("corroborated signals: "), F.array_join(signals, ", "))
    gone = {"signals": signals, "context_only": ~F.array_contains("hard", "duplicate_of_previous"), "drop_reason": reason}
    return judged.withColumns({k: F.when(F.col("dropped"), v) for k, v in gone.items()}).withColumn("cps", F.round("cps", 2)).drop("hard", "soft")


def gate_cues(cues: DataFrame, windows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of ``judged_cues``: two plans over the same rows; what needs both takes the one table."""
    judged = judged_cues(cues, windows)
    return judged.where("not dropped").select(cues.columns), judged.where("dropped").drop("dropped")


def absorb(judged: DataFrame) -> DataFrame:
    """As-of join within one table: the last kept cue before a hole is held over it, at most 6 s and to 80 ms before the next cue.

    Windows of one partitioning find the owner of each dropped cue and the end of its hole; kept cues are returned.
    """
    own = Window.partitionBy("video_id").orderBy("start_ms", "dropped", "cue_id").rowsBetween(Window.unboundedPreceding, 0)
    df = judged.withColumn("__owner", F.last(F.when(~F.col("dropped"), F.col("cue_id")), ignorenulls=True).over(own))
    hole = F.max(F.when(F.col("dropped") & (F.col("end_ms") > F.col("start_ms")), F.col("end_ms"))).over(Window.partitionBy("video_id", "__owner"))
    df = df.withColumn("__hole", hole).where(~F.col("dropped")).withColumn("__next", F.lead("start_ms").over(_order()))
    limit = F.least(F.col("__hole"), F.col("start_ms") + MAX_CUE_MS, F.coalesce(F.col("__next") - MIN_GAP_MS, F.col("start_ms") + MAX_CUE_MS))
    held = F.when(F.col("__hole").isNotNull() & (limit > F.col("end_ms")), limit).otherwise(F.col("end_ms"))
    return df.withColumn("end_ms", held).drop("__owner", "__next", "__hole", "dropped")


def absorb_dropped_time(cues: DataFrame, dropped: DataFrame) -> DataFrame:
    """``absorb`` of two tables."""
    both = cues.withColumn("dropped", F.lit(False)).unionByName(dropped.select("video_id", "cue_id", "start_ms", "end_ms").withColumn("dropped", F.lit(True)), allowMissingColumns=True)
    return absorb(both)


def context_carriers(judged: DataFrame) -> DataFrame:
    """Kept cues and the readable dropped ones, marked context_only, numbered anew in time order."""
    rows = judged.select("video_id", "cue_id", "start_ms", "end_ms", "text", "dropped", (F.col("dropped") & F.coalesce("context_only", F.lit(False))).alias("context_only"))
    order = Window.partitionBy("video_id").orderBy("start_ms", "context_only", "cue_id")
    return rows.where("not dropped or context_only").drop("dropped").withColumn("seq", F.row_number().over(order))


def gate_audit(dropped: DataFrame) -> DataFrame:
    """Drop counts by signal and context_only, with subtotals (null)."""
    return dropped.select("context_only", F.explode("signals").alias("signal")).cube("signal", "context_only").agg(F.count("*").alias("n"))
