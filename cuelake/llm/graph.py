"""Connected components by alternating large-star and small-star rounds.

Each round is two grouped minima (combined on the map side) joined back to the edges,
so a vertex with very many edges never has to be gathered: the join on it is an
ordinary shuffle join, which adaptive execution splits when it is skewed.  Edges are
written to the shared folder after each round; nothing of the graph reaches the driver
but whether it has come to rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every vertex is either the lower end of its edges or the upper end of one, which further rounds leave as it is."""
    ends = edges.select(F.col("hi").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("lo").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest node.

    Null ends and self-loops are ignored; direction and repeats don't matter.
    """
    now = materialize(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        if _are_stars(now):
            break
        was, now = now, materialize(_small_star(_large_star(now)), "edges")
        discard(was)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
