"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent e and normalised. The exponent is found by repeated
section of [0, 1]: either the one whose weights have a target entropy, or the smallest one (the most
even mix) under which no source repeats more than a limit. Each section evaluates all its points in
one aggregation over the table of sources, which stays distributed. Weights become token budgets,
and budgets become epochs of permuted blocks: each source is dealt into blocks by hash, an epoch
orders the blocks by a hash of its own, whole epochs take every document, and the last one takes
documents in that order while they fit the budget.

The budget ``None`` is the smallest with which every source is seen whole at least once, so nothing
is dropped; a number of tokens may cut large sources short.

Defined cases: null and empty sources are one source; a null or empty text has no tokens and comes
once with each epoch; sources without tokens come once; repeated rows are rows of their own, and rows
with null or repeated ids are dealt by id and text; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

POINTS, ROUNDS = 32, 6
DOCS_A_BLOCK, MOST_BLOCKS = 256, 4096


def count_tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def source_shares(rows: DataFrame) -> DataFrame:
    """(source, tokens, docs, share): one row for each source."""
    sums = cut(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "mixing-sources")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    return sums.withColumn("share", F.col("tokens") / F.lit(max(1, total)))


def exponent(shares: DataFrame, target_entropy: float | None = None, max_repeat: float = 2.0, budget: int | None = None) -> float:
    """The exponent in [0, 1].

    Entropy (in nats) and the largest repetition both fall as the exponent grows: below some exponent
    the mix is too even. That point is cut out of [0, 1] by sections of ``POINTS`` parts.
    """
    some = shares.where("share > 0")

    def too_even(z: float, log_sum: float, most: float, least: float, tokens: int, e: float) -> bool:
        if target_entropy is not None:
            return math.log(z) - e * log_sum / z > target_entropy
        return (most / least if budget is None else most / z * budget / tokens) > max_repeat

    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / POINTS for i in range(POINTS + 1)]
        sums = [F.sum("tokens")]
        for e in points:
            power, rate = F.pow("share", F.lit(e)), F.pow("share", F.lit(e - 1))
            sums += [F.sum(power), F.sum(power * F.log("share")), F.max(rate), F.min(rate)]
        row = some.agg(*[x.alias(f"c{i}") for i, x in enumerate(sums)]).first()
        if row[0] is None:
            return 1.0
        even = [i for i, e in enumerate(points) if too_even(*row[1 + 4 * i : 5 + 4 * i], row[0], e)]
        if not even:
            return low
        if even[-1] == POINTS:
            return high
        low, high = points[even[-1]], points[even[-1] + 1]
    return high


def mix(docs: DataFrame, target_entropy: float | None = None, max_repeat: float = 2.0, budget: int | None = None, seed: int = 17) -> DataFrame:
    """(doc_id, source, tokens, epoch, block, block_order, doc_order): a row for each time a document is seen.

    Reading order within a source is epoch, block_order, doc_order.
    """
    rows = cut(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), count_tokens().alias("tokens"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("doc_order")), "mixing-rows")
    shares = source_shares(rows)
    e = exponent(shares, target_entropy, max_repeat, budget)
    rate = F.when(F.col("share") > 0, F.pow("share", F.lit(e - 1)))
    least, z, total = shares.select(rate.alias("r"), "tokens", F.pow("share", F.lit(e)).alias("w"), "share").agg(F.min("r"), F.sum(F.when(F.col("share") > 0, F.col("w"))), F.sum("tokens")).first()
    repeat = rate / F.lit(least) if budget is None else rate / F.lit(z) * F.lit(budget / max(1, total or 0))
    plan = shares.select(
        "source",
        F.when(F.col("tokens") > 0, F.floor(F.col("tokens") * repeat + 0.5)).alias("budget"),
        F.col("tokens").alias("all_tokens"),
        F.least(F.lit(MOST_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("docs") / DOCS_A_BLOCK))).cast("long").alias("n_blocks"),
    ).select("source", "n_blocks", F.coalesce(F.expr("budget div all_tokens"), F.lit(1)).alias("whole"), F.coalesce(F.expr("budget % all_tokens"), F.lit(0)).alias("rest"))
    dealt = rows.join(plan, "source").withColumn("block", F.pmod("doc_order", "n_blocks"))

    # the last, partial epoch: whole blocks while they fit, then documents of the next block
    order = F.xxhash64("source", "block", "whole", F.lit(seed))
    blocks = dealt.where("rest > 0").groupBy("source", "block", "whole", "rest").agg(F.sum("tokens").alias("block_tokens"))
    before = F.sum("block_tokens").over(W.partitionBy("source").orderBy(order, "block")) - F.col("block_tokens")
    begun = blocks.withColumn("left", F.col("rest") - before).where("left > 0").select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "left", (F.col("block_tokens") <= F.col("left")).alias("fits"))
    partial = dealt.where("rest > 0").join(begun, (F.col("source") == F.col("b_source")) & (F.col("block") == F.col("b_block")))
    so_far = F.sum("tokens").over(W.partitionBy("source", "block").orderBy("doc_order", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    cut_block = partial.where("not fits").withColumn("so_far", so_far).where("so_far <= left")
    names = ["doc_id", "source", "tokens", "doc_order", "block"]
    last = partial.where("fits").select(*names, F.col("whole").alias("epoch")).unionByName(cut_block.select(*names, F.col("whole").alias("epoch")))
    whole = dealt.where("whole > 0").select(*names, F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("epoch"))
    return whole.unionByName(last).select("doc_id", "source", "tokens", "epoch", "block", F.xxhash64("source", "block", "epoch", F.lit(seed)).alias("block_order"), F.xxhash64("doc_order", "epoch").alias("doc_order"))
