"""All registered queries of the engine's own operators, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.operators import layout
from cuelake.plans import bindings as B
from cuelake.plans import cue_queries, more_queries, stat_queries, stream_queries, text_queries

QUERIES = {**cue_queries.QUERIES, **stat_queries.QUERIES, **text_queries.QUERIES, **stream_queries.QUERIES, **more_queries.QUERIES}
ORACLES = {**cue_queries.ORACLES, **stat_queries.ORACLES, **text_queries.ORACLES, **stream_queries.ORACLES, **more_queries.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to timed cues to reading speed: cues and the share within budget by language."""
    videos = B.videos(spark, sf_dir)
    cues = cue_queries.sentence_cues(spark, sf_dir, text=False)
    report = layout.cps_report(layout.attach_layout(cues, videos, "source_lang"), "source_lang")
    return report.groupBy("source_lang").agg(F.count("*").alias("cues"), F.round(F.avg(F.col("ok").cast("double")), 4).alias("share_ok"), F.max("chars").alias("longest"))


QUERIES["flagship"] = flagship
ORACLES["flagship"] = B.with_ctes("words videos", f"""with {cue_queries.SENTENCES}, {cue_queries.LEAD_OUT}, {cue_queries.LAYOUT}, m as (
  select l.video_id, source_lang, length(trim(text)) as chars, greatest(0, end_ms - start_ms) as ms, cue_chars from led l join sized using (video_id))
select source_lang, count(*) as cues, round(avg(cast(chars <= cue_chars and (ms <= 0 or chars * 1000 <= 17 * ms) as integer)), 4) as share_ok, cast(max(chars) as integer) as longest from m group by 1""")
