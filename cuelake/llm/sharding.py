"""Permutation-filled lookup tables: balanced, stable placement of documents on shards.

Each shard prefers the slots of a prime-sized table in its own order (an offset and a step
hashed from its name).  Shards take turns, each claiming its first free preference, until the
table is full.  The table depends on the shard names and the size alone (about a hundred slots
a shard), never on the data; it is broadcast, and placing a document is one hash and one
lookup, with no shuffle whatever the skew of the documents.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import md5_number

MAX_SLOTS = 1 << 20


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _number(text: str, digits: int = 12) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)


def fill_table(shards: list[str], slots: int) -> list[int]:
    """The shard number in each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be a non-empty list of distinct names")
    if not is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    at = [_number(f"{s}:offset") % slots for s in shards]
    step = [_number(f"{s}:step") % (slots - 1) + 1 for s in shards]
    out, left = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            while out[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            out[at[k]] = k
            left -= 1
            if not left:
                return out


def lookup(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """(slot, shard, shard_name), one row a slot."""
    return spark.createDataFrame([(i, k, shards[k]) for i, k in enumerate(fill_table(shards, slots))], "slot bigint, shard int, shard_name string")


def place(docs: DataFrame, shards: list[str], slots: int, key: str = "doc_id") -> DataFrame:
    """``docs`` with slot, shard and shard_name by the hashed ``key``; a null key counts as ''.

    Equal keys go to equal shards.  Columns of ``docs`` with these three names are replaced.
    """
    kept = docs.drop("slot", "shard", "shard_name")
    slot = (md5_number(F.coalesce(F.col(key).cast("string"), F.lit(""))) % slots).alias("slot")
    return kept.select("*", slot).join(F.broadcast(lookup(docs.sparkSession, shards, slots)), "slot", "left").select(*kept.columns, "slot", "shard", "shard_name")
