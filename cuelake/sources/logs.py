"""Worker logs to metric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_worker_logs(lines: DataFrame) -> DataFrame:
    """``lines`` with batch_s, worker and in_flight taken from the text of ``line`` (null where it says nothing)."""
    part = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    return lines.withColumn("batch_s", part(r"took ([0-9.]+)s").try_cast("double")).withColumn("worker", part(r"worker-([0-9]+)")).withColumn("in_flight", part(r"in flight ([0-9]+)").try_cast("int"))


def run_metrics(rows: DataFrame) -> DataFrame:
    """Per test: total, mean, least and most batch time, distinct workers, most in flight."""
    return rows.groupBy("test").agg(F.round(F.sum("batch_s"), 2).alias("total_s"), F.round(F.avg("batch_s"), 4).alias("avg_s"), F.min("batch_s").alias("min_s"), F.max("batch_s").alias("max_s"), F.countDistinct("worker").alias("workers"), F.max("in_flight").alias("in_flight"))


#: size of the sketches: distinct counts are off by about 1.6 %, ranks of quantiles by about 1.7 %
LG_K, KLL_K = 12, 200


def metric_sketches(rows: DataFrame, day: str = "date") -> DataFrame:
    """Sketches of each (test, day) to be stored: batches, total and extremes, a HyperLogLog of workers, a KLL of batch times."""
    return rows.groupBy("test", day).agg(
        F.count("batch_s").alias("batches"), F.sum("batch_s").alias("total_s"), F.min("batch_s").alias("min_s"), F.max("batch_s").alias("max_s"),
        F.hll_sketch_agg("worker", F.lit(LG_K)).alias("workers"), F.kll_sketch_agg_double("batch_s", F.lit(KLL_K)).alias("times"),
    )


def merged_metrics(sketches: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Per test over any days of ``metric_sketches``: batches, total, extremes, about how many distinct workers, and batch time at each share."""
    merged = sketches.groupBy("test").agg(
        F.sum("batches").alias("batches"), F.round(F.sum("total_s"), 2).alias("total_s"), F.min("min_s").alias("min_s"), F.max("max_s").alias("max_s"),
        F.hll_sketch_estimate(F.hll_union_agg("workers")).alias("workers"), F.kll_merge_agg_double("times").alias("times"),
    )
    at = F.array(*(F.kll_sketch_get_quantile_double("times", F.lit(s)) for s in shares))
    return merged.withColumn("quantiles", at).drop("times")
