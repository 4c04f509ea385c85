"""Skip sets: rows whose composite keys are known already are left out, a Bloom filter sparing the others the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Bits of a filter for each known key, hashes of a key, and the bits of the largest filter (4 MB).
KEY_BITS, HASHES, MOST_BITS = 12, 6, 1 << 25


def _words(keys: list[Column], bits: int) -> list[tuple[Column, Column]]:
    """(number of the 64-bit word, bit in it) of each hash of a key. Two hashes give all others by sums of their multiples."""
    a, b = F.xxhash64(F.lit(1), *keys), F.xxhash64(F.lit(2), *keys)
    places = [F.pmod(F.shiftrightunsigned(a, 24) + F.lit(i).cast("long") * F.shiftrightunsigned(b, 24), F.lit(bits).cast("long")) for i in range(HASHES)]
    return [((p / 64).cast("long"), (p % 64).cast("int")) for p in places]


def bloom_words(known: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """(words): one row with the 64-bit words of the Bloom filter of the keys, of the given bits whatever the number of keys."""
    spots = known.select(F.explode(F.array(*(F.struct(w.alias("w"), b.alias("b")) for w, b in _words([F.col(k) for k in keys], bits)))).alias("x"))
    # each word is an OR of few bits per task, then of tasks
    words = spots.groupBy("x.w").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x.b"))).alias("v"))
    every = known.sparkSession.range(bits // 64).select(F.col("id").alias("w")).join(words, "w", "left").select(F.struct("w", F.coalesce("v", F.lit(0).cast("long")).alias("v")).alias("x"))
    return every.agg(F.array_sort(F.collect_list("x")).alias("x")).select(F.col("x.v").alias("words"))


def may_hold(words: Column, keys: list[Column], bits: int) -> Column:
    """False if a key is surely not in the filter."""
    each = [F.call_function("getbit", F.element_at(words, (w + 1).cast("int")), b) == 1 for w, b in _words(keys, bits)]
    return reduce(lambda a, b: a & b, each)


def filter_bits(n: int) -> int:
    """Bits of a filter for n keys: a power of two, MOST_BITS at most."""
    return min(MOST_BITS, max(1 << 10, 1 << (KEY_BITS * n - 1).bit_length()))


def skip_known(incoming: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of incoming whose keys are not among known's; a key with a null part is never known.

    A Bloom filter of the known keys, of 12 bits a key and 4 MB at most, goes along as a constant: rows that it does not hold are new for sure, and are not shuffled. The few
    others, 0.4 % of the new ones beside the known, are compared exactly. The filter is built from sums per word, so that keys never meet in one place; with more known keys than
    about 2.8 million it lets more rows through to the exact comparison, which stays right.
    """
    there = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    whole = known.filter(there).select(*keys)
    n = whole.count()
    if n == 0:
        return incoming
    bits = filter_bits(n)
    words = cut(bloom_words(whole, keys, bits))
    flagged = incoming.withColumn("_maybe", there & may_hold(words.scalar(), [F.col(k) for k in keys], bits))
    maybe = flagged.filter("_maybe").drop("_maybe").join(whole, keys, "left_anti").select(*incoming.columns)
    return flagged.filter("not _maybe").drop("_maybe").unionByName(maybe)
