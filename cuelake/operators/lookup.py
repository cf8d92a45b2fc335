"""Localised messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def message_lookup(df: DataFrame, messages: DataFrame, fallback: str = "en") -> DataFrame:
    """``df`` with the message for its lang and key, else that of the fallback language, else the key."""
    own = messages.select("lang", "key", F.col("message").alias("__own"))
    other = messages.where(F.col("lang") == fallback).select("key", F.col("message").alias("__other"))
    return df.join(own, ["lang", "key"], "left").join(other, "key", "left").withColumn("message", F.coalesce("__own", "__other", "key")).drop("__own", "__other")
