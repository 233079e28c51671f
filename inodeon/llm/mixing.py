"""Mixing sources to target weights by temperature (operator 8).

Every source's token share is raised to an exponent between 0 (all sources alike) and 1 (as they are) and normalised. The exponent is the
largest one that meets the target: an entropy of at least ``target_entropy`` bits, or no less than it takes for ``max_repeats``, the
smallest exponent at which no source is read more than so many times; it is found by bisection, into 32 parts a round instead of two, so
that six jobs over the sources' totals do. The
budget is the total at which the source with the fewest repeats is read exactly once, or ``budget`` tokens.

Weights become documents by block permutations: a source's documents fall into blocks by hash, every epoch orders the blocks anew by a
seeded hash, a block's documents have a place by another one, and epoch after epoch is read in that order until the source's share of the
budget is met. Whole blocks need only their totals; documents are counted one by one in the one block of a source where the budget ends. Hot
sources thus spread over as many blocks as their size asks for. ``read_order`` has all of it, so that its rows sorted by source, epoch, block_rank,
block, place and doc_id are the reads in their order.

Edge cases: a null source is a source of its own; null and empty texts count no tokens and go with their block; sources
without any tokens are read once; repeated rows are rows of their own; an empty table gives an empty result; other columns pass through
``mix`` unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inodeon.llm.common import cut, small_enough

MAX_REPEATS = 2.0
SEED = 20240501
#: Documents of a block, about.
BLOCK_ROWS = 512
#: Rows of source or block totals that are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST = 200_000
_WORD = r"[^\x20\x09-\x0D]+"
#: Exponents tried at once, and rounds of narrowing; together they fix the exponent to about 1e-9.
_GRID, _ROUNDS = 32, 6


def tokens(text: str = "text") -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(_WORD)).cast("long")


def exponent(totals: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None) -> float:
    """The exponent for the target, from ``n_tokens`` by source.

    Each round tries a grid of exponents in one aggregate and goes on within the interval where the target is met, so
    that no list of sources comes to the driver.
    """
    sized = totals.where("n_tokens > 0").select(F.log("n_tokens").alias("size"))
    ends = sized.agg(F.max("size").alias("top"), F.min("size").alias("least")).first()
    if ends["top"] is None:
        return 1.0
    size = F.col("size") - ends["top"]

    def met(tried: list[float]) -> list[bool]:
        if target_entropy is None:  # repeats fall as the exponent grows
            return [math.exp((a - 1) * (ends["least"] - ends["top"])) <= max_repeats for a in tried]
        sums = sized.agg(*(F.sum(F.exp(a * size)).alias(f"w{i}") for i, a in enumerate(tried)), *(F.sum(F.exp(a * size) * a * size).alias(f"e{i}") for i, a in enumerate(tried))).first()
        bits = [(math.log(sums[f"w{i}"]) - sums[f"e{i}"] / sums[f"w{i}"]) / math.log(2) for i in range(len(tried))]
        return [b >= target_entropy for b in bits]  # entropy falls as the exponent grows

    low, high = 0.0, 1.0
    for _ in range(_ROUNDS):
        tried = [low + (high - low) * i / _GRID for i in range(_GRID + 1)]
        good = met(tried)
        if target_entropy is None:
            at = good.index(True)  # the smallest exponent that meets the limit; 1 always does
            if at == 0:
                return tried[0]
            low, high = tried[at - 1], tried[at]
        else:
            at = max((i for i, ok in enumerate(good) if ok), default=0)  # the largest that meets it, or 0 if none does
            if at == _GRID:
                return tried[-1]
            low, high = tried[at], tried[at + 1]
    return high if target_entropy is None else low


def plan(totals: DataFrame, a: float, budget: int | None = None) -> DataFrame:
    """``(source, n_tokens, weight, quota)``: each source's normalised weight and its tokens of the budget."""
    top = totals.agg(F.max("n_tokens").alias("t")).first()["t"] or 0
    if not top:
        return totals.withColumns({"weight": F.lit(0.0), "quota": F.lit(0).cast("long")})
    raw = F.when(F.col("n_tokens") > 0, F.exp(a * F.log(F.col("n_tokens") / F.lit(float(top))))).otherwise(0.0)
    norm = totals.agg(F.sum(raw).alias("w")).first()["w"]
    weight = raw / norm
    total = F.lit(float(budget)) if budget is not None else F.lit(float(top) * norm)
    quota = F.round(weight * total).cast("long")
    if budget is None:  # rounding must not take the last document from the source that is read once
        quota = F.greatest(quota, F.col("n_tokens"))
    return totals.withColumn("weight", weight).withColumn("quota", quota)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_source": docs["source"].cast("string"), "_hash": F.xxhash64(F.coalesce(docs["text"], F.lit(""))), "_id": docs["doc_id"]})


def _block_rank(epoch: Column, seed: int) -> Column:
    return F.xxhash64("_source", "block", F.lit(seed + 1), epoch.cast("long"))


def _place(seed: int) -> Column:
    return F.xxhash64("_id", "_hash", F.lit(seed + 2))


def schedule(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """``(_source, _id, _hash, n_tokens, block, repeats)``: how often each different document is read."""
    rows = _narrow(docs).select("_source", "_id", "_hash", tokens().alias("_tokens"))
    units = cut(rows.groupBy("_source", "_id", "_hash").agg(F.sum("_tokens").alias("_tokens"), F.max("_tokens").alias("n_tokens")))
    totals = cut(units.groupBy("_source").agg(F.sum("_tokens").alias("n_tokens"), F.count("*").alias("n_rows")))
    quotas = plan(totals, exponent(totals, max_repeats, target_entropy), budget)
    quotas = cut(quotas.select(F.col("_source").alias("_s"), F.col("n_tokens").alias("total"), "quota", F.ceil(F.col("n_rows") / BLOCK_ROWS).cast("long").alias("n_blocks")))
    side = F.broadcast(quotas) if small_enough(quotas, MAX_BROADCAST) else quotas
    units = units.join(side, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    units = cut(units.withColumn("block", F.pmod(F.xxhash64("_id", "_hash", F.lit(seed)), F.col("n_blocks"))))

    blocks = units.groupBy("_source", "block", "total", "quota").agg(F.sum("_tokens").alias("size"))
    full = F.when(F.col("total") > 0, F.expr("quota div total")).otherwise(F.lit(1).cast("long"))
    # the last epoch's blocks are read by rank; running sums go over the ranks' high bits first, so that no source's blocks all meet in one task
    blocks = blocks.withColumn("full", full).withColumn("block_rank", _block_rank(F.col("full"), seed)).withColumn("part", F.shiftright("block_rank", 52))
    blocks = cut(blocks)
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy(F.col("_source").alias("_s"), F.col("part").alias("_p")).agg(F.sum("size").alias("in_part"))
    parts = parts.withColumn("base", F.coalesce(F.sum("in_part").over(before("_s").orderBy("_p")), F.lit(0))).drop("in_part")
    blocks = blocks.withColumn("inner", F.coalesce(F.sum("size").over(before("_source", "part").orderBy("block_rank", "block")), F.lit(0)))
    blocks = blocks.join(parts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))
    left = F.when(F.col("total") > 0, F.col("quota") - F.col("full") * F.col("total") - F.col("base") - F.col("inner")).otherwise(F.lit(0))
    blocks = blocks.select(F.col("_source").alias("_s"), F.col("block").alias("_b"), "size", "full", left.alias("left"))
    blocks = cut(blocks)

    side = F.broadcast(blocks) if small_enough(blocks, MAX_BROADCAST) else blocks
    units = units.join(side, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    partial = (F.col("left") > 0) & (F.col("left") < F.col("size"))
    extra = F.when(F.col("left") >= F.greatest("size", F.lit(1)), 1).otherwise(0)
    in_order = before("_source", "block").orderBy(_place(seed), "_id", "_hash")
    whole = units.where(~partial).withColumn("repeats", F.col("full") + extra)
    split = units.where(partial).withColumn("prior", F.coalesce(F.sum("_tokens").over(in_order), F.lit(0)))
    split = split.withColumn("repeats", F.col("full") + F.when(F.col("prior") < F.col("left"), 1).otherwise(0)).drop("prior")
    both = whole.unionByName(split)
    return both.select("_source", "_id", "_hash", "n_tokens", "block", F.col("repeats").cast("int").alias("repeats"))


def read_order(docs: DataFrame, seed: int = SEED, **target: object) -> DataFrame:
    """One row for every time a document is read: ``(doc_id, source, n_tokens, epoch, block, block_rank, place)``, without texts."""
    plan_of = schedule(docs, seed=seed, **target)
    keys = _narrow(docs).select(F.col("_source").alias("source"), F.col("_id").alias("doc_id"), F.col("_hash").alias("h"))
    same = keys["source"].eqNullSafe(plan_of["_source"]) & keys["doc_id"].eqNullSafe(plan_of["_id"]) & (keys["h"] == plan_of["_hash"])
    read = keys.join(plan_of, same).where("repeats > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
    return read.select("doc_id", "source", "n_tokens", "epoch", "block", _block_rank(F.col("epoch"), seed).alias("block_rank"), _place(seed).alias("place"))


def mix(docs: DataFrame, **target: object) -> DataFrame:
    """The documents, each as often as it is read, with their own columns."""
    plan_of = schedule(docs, **target).withColumnsRenamed({"_source": "_s", "_id": "_i", "_hash": "_h"}).select("_s", "_i", "_h", "repeats")
    same = F.col("_source").eqNullSafe(F.col("_s")) & F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h"))
    # a row's own columns travel in one struct, so that none can clash with those added here
    rows = _narrow(docs).select("_source", "_id", "_hash", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    read = rows.join(plan_of, same).where("repeats > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return read.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
