"""Temperature mixing of sources, in DataFrame operations only.

Token shares are raised to an exponent between 0 (all sources alike) and 1 (as they are);
the exponent is bisected until the weights reach a target entropy or keep within a limit
of repetition.  Each source's budget is then met by whole passes over its documents (blocks),
the last one cut in the order of a hashed permutation.

Documents are never gathered by source: a source's cut is one key, found from token sums
of hash ranges and then inside the one range that holds it.  Applying the plan is a join
with one row for each source, so a source with a third of all rows costs no skewed shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelake.llm.common import as_row, materialize

STEPS, BITS_A_JOB = 24, 8


def token_count(text: Column) -> Column:
    """Runs of characters other than space, tab, line feed and carriage return; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("bigint")


def permutation_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def _holds(totals: DataFrame, alphas: list[float], entropy_share: float | None, max_repetition: float | None) -> dict[float, bool]:
    """Whether each exponent satisfies the target; sources are summed by Spark, however many there are, for all exponents in one job."""
    rows = totals.select("share", F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))
    p, use = F.pow(F.col("share"), F.col("alpha")), F.pow(F.col("share"), F.col("alpha") - 1.0)
    sums = rows.groupBy("alpha").agg(F.sum(p).alias("z"), F.sum(p * F.log("share")).alias("zlog"), F.count("*").alias("n"), F.max(use).alias("most"), F.min(use).alias("least")).collect()
    if entropy_share is not None:
        return {r.alpha: math.log(r.z) - r.alpha * r.zlog / r.z >= entropy_share * math.log(r.n) for r in sums}
    return {r.alpha: r.most / r.least <= max_repetition for r in sums}


def exponent(totals: DataFrame, entropy_share: float | None = None, max_repetition: float | None = None) -> float:
    """Bisect the exponent to STEPS binary places, rounded to six decimal ones; a job settles BITS_A_JOB of them.

    With ``entropy_share``: the largest exponent whose weights have at least that share of the
    greatest possible entropy.  With ``max_repetition``: the smallest exponent at which no source
    is repeated more often than that for each use of the least repeated one.
    """
    if (entropy_share is None) == (max_repetition is None):
        raise ValueError("give either entropy_share or max_repetition")
    if totals.isEmpty():
        return 1.0
    low, width = 0.0, 1.0
    for k in range(STEPS // BITS_A_JOB):
        width /= 1 << BITS_A_JOB
        inner = [low + i * width for i in range(1, 1 << BITS_A_JOB)]
        ends = [] if k else [0.0, 1.0]
        ok = _holds(totals, inner + ends, entropy_share, max_repetition)
        if entropy_share is not None and not k and ok[1.0]:
            return 1.0
        if max_repetition is not None and not k and ok[0.0]:
            return 0.0
        below = (lambda x: ok[x]) if entropy_share is not None else (lambda x: not ok[x])  # noqa: B023
        a, b = 0, 1 << BITS_A_JOB  # bisect among what the job has settled
        while b - a > 1:
            middle = (a + b) // 2
            a, b = (middle, b) if below(inner[middle - 1]) else (a, middle)
        low += a * width
    return round(low if entropy_share is not None else low + width, 6)


def mixing_plan(docs: DataFrame, entropy_share: float | None = None, max_repetition: float | None = None, budget: int | None = None, whole: bool = False, seed: int = 17, digits: int = 3) -> DataFrame:
    """One row for each source with tokens: source, tokens, weight, budget, full_blocks, cut_key.

    ``budget`` defaults to the tokens of the corpus; with ``whole`` it is the least budget that
    uses every document at least once.  ``cut_key`` is the largest permutation key that the last,
    partial block takes ('' for none).  A source without tokens has no weight and no row.
    """
    sized = materialize(docs.select(F.col("source"), permutation_key(F.col("doc_id"), seed).alias("key"), token_count(F.col("text")).alias("tokens")), "sizes")
    ranges = materialize(sized.groupBy("source", F.substring("key", 1, digits).alias("bucket")).agg(F.sum("tokens").alias("tokens")), "ranges")
    tokens = ranges.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    total = tokens.agg(F.sum("tokens")).first()[0] or 0
    totals = materialize(tokens.withColumn("share", F.col("tokens") / F.lit(float(total or 1))), "totals")
    alpha = exponent(totals, entropy_share, max_repetition)
    power = F.pow(F.col("share"), F.lit(alpha))
    z, least = totals.agg(F.sum(power), F.min(power / F.col("tokens"))).first()
    z = z or 1.0
    if budget is None:
        budget = math.ceil(z / least) if whole and least else total
    plan = totals.select("source", "tokens", (power / F.lit(z)).alias("weight"))
    # with ``whole`` the least repeated source must come out at one block, so rounding may not take its last token
    amount = F.greatest(F.floor(F.col("weight") * F.lit(float(budget))), F.col("tokens")) if whole else F.floor(F.col("weight") * F.lit(float(budget)))
    plan = plan.withColumn("budget", amount.cast("bigint")).withColumn("full_blocks", F.floor(F.col("budget") / F.col("tokens")).cast("int")).withColumn("rest", F.col("budget") - F.col("full_blocks") * F.col("tokens"))
    plan = materialize(plan, "plan")
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = ranges.withColumn("before", before).alias("r").join(plan.alias("p"), F.expr("r.source <=> p.source")).where("r.before < p.rest and r.before + r.tokens >= p.rest").select("r.source", "r.bucket", "r.before", "p.rest")
    inside = sized.withColumn("bucket", F.substring("key", 1, digits)).alias("s").join(edge.select("source", "bucket", "before", "rest").alias("e"), F.expr("s.source <=> e.source and s.bucket = e.bucket")).groupBy("s.source", "s.key", "e.before", "e.rest", "e.bucket").agg(F.sum("s.tokens").alias("tokens"))
    here = F.coalesce(F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = inside.withColumn("here", here).where("before + here < rest").groupBy("source").agg(F.max("key").alias("cut_key"))
    out = plan.alias("p").join(cut.alias("c"), F.expr("p.source <=> c.source"), "left").select("p.source", "p.tokens", "p.weight", "p.budget", "p.full_blocks", F.coalesce("c.cut_key", F.lit("")).alias("cut_key"))
    return materialize(out, "mix")


def mix(docs: DataFrame, plan: DataFrame, seed: int = 17, block_col: str = "block") -> DataFrame:
    """``docs`` with a column ``block_col`` (replaced if present): one row for each use of a document under ``plan``.

    Sorting by (block, permutation_key) gives the order of the block permutations.  All other columns of
    ``docs`` are kept, whatever their names; a null source is a source like others.  Rows without an id share one place in
    the permutation, as do rows of equal id.
    """
    key = permutation_key(F.col("doc_id"), seed)
    rows = docs.select(as_row(docs).alias("row"), F.col("source").alias("source"), key.alias("key"))
    p = plan.select(F.col("source").alias("of"), "full_blocks", "cut_key")
    uses = F.col("full_blocks") + F.when(F.col("key") <= F.col("cut_key"), 1).otherwise(0)
    joined = rows.join(p, F.col("source").eqNullSafe(F.col("of")), "inner").withColumn("uses", uses).where("uses > 0")
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c != block_col]
    return joined.select(*kept, F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias(block_col))
