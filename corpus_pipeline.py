"""The training-data pipeline: raw documents to packed sequences in five stages.

Each stage is written as Parquet and read again as the next one's input, so a stage can be
run anew by itself.  Stages 1 to 4 return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import langid, mixing, neardup, packing, spans
from cuelake.llm.common import table
from cuelake.sources.streams import shared_folder

#: a document stays if its likeliest language has at least this posterior
MIN_SCORE = 0.5
#: rows of an Arrow batch: whole documents of several kilobytes each, so fewer than Spark's default keep Python workers small
BATCH_ROWS = "1000"
#: no source is used more often than this for each use of the least repeated one
MAX_REPETITION = 1.25


def _small_batches(spark: SparkSession) -> None:
    """Batches of ``BATCH_ROWS``, unless the session has a size of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # the default
        spark.conf.set(name, BATCH_ROWS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without letters and those that no learned language explains better than the rest together."""
    _small_batches(spark)
    model = langid.train(docs)
    return langid.predict(docs, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= MIN_SCORE)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of texts whose five-word shingles are 0.8 similar."""
    _small_batches(spark)
    return neardup.keep_one(docs).select(docs.columns)


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut sentences that repeat an earlier run; a document of nothing else goes."""
    _small_batches(spark)
    cut = spans.drop_repeated_spans(docs)
    return cut.where((F.col("n_words_removed") == 0) | (F.trim(F.col("text")) != "")).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Flatten the sources within the repetition limit; every document is used at least once."""
    plan = mixing.mixing_plan(docs, max_repetition=MAX_REPETITION, whole=True)
    return mixing.mix(docs, plan, block_col="__use").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a sequence of at most 2048 tokens."""
    _small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_spans),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Naive Bayes, SimHash and tokenisers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        path = f"{shared_folder(spark)}/stage-{k}-{uuid.uuid4().hex}"
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    raise ValueError("no stages")
