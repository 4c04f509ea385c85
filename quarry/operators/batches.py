"""Batches of training examples of like length under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .split import seeded_rank


def length_range(length: Column, least: int, budget: int) -> Column:
    """The upper bound of the range of a length: powers of two times least, the budget being the last."""
    power = F.ceil(F.log2(F.greatest(length, F.lit(least)).cast("double") / least))
    return F.least(F.lit(budget), (F.pow(F.lit(2.0), power) * least).cast("long"))


def token_batches(examples: DataFrame, budget: int, seed: int = 42, least: int = 16) -> DataFrame:
    """id, length, range, batch, slot, per_batch of examples (id, length): examples of one range of lengths fill batches of as many as the budget holds when each is padded to the range's bound.

    The order of a range is seeded; ranks are counted by ranges of hashes first, so that neither a range nor the whole is ordered by one task. batch numbers the batches of a range, slot the
    examples of a batch. An example that is longer than the budget, or has no length, fits no batch and has null ones.
    """
    sized = examples.select("id", "length", F.when(F.col("length").between(0, budget), length_range(F.col("length"), least, budget)).alias("range"))
    ranked = seeded_rank(sized.filter("range is not null"), "range", seed)
    per = F.floor(F.lit(budget) / F.col("range"))
    placed = ranked.select("id", "length", "range", F.floor(F.col("r") / per).alias("batch"), (F.col("r") % per).alias("slot"), per.alias("per_batch"))
    rest = sized.filter("range is null").select("id", "length", "range", *(F.lit(None).cast("long").alias(c) for c in ("batch", "slot", "per_batch")))
    return placed.unionByName(rest)


def fill_rates(batches: DataFrame) -> DataFrame:
    """range, n_batches, n, fill: the share of each range's padded batches that is tokens; a batch has per_batch * range places."""
    own = batches.filter("batch is not null").groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens"), (F.max("batch") + 1).alias("n_batches"), F.max("per_batch").alias("per_batch"))
    return own.select("range", "n_batches", "n", (F.col("tokens") / (F.col("n_batches") * F.col("per_batch") * F.col("range"))).alias("fill"))
