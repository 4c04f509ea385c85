"""Keeping a mirror in step: digests of key ranges tell where two tables differ, and only those ranges are compared row by row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Ranges of key hashes are 2 to the power of BITS; a node of the digest tree has 2 to the power of STEP children.
BITS, STEP = 16, 4


def _leaf(key: list[str], bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - bits)


def _digest(columns: list[str]) -> list[Column]:
    """How many rows there are, and two sums of their hashes that no order changes."""
    return [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(2), *columns)).alias("mix")]


def range_digests(df: DataFrame, key: list[str], columns: list[str], bits: int = BITS) -> DataFrame:
    """(node, n, sum, mix) of each range of key hashes that has rows: what a side has to tell of itself. Each task sends one row for each range at most."""
    return df.groupBy(_leaf(key, bits).alias("node")).agg(*_digest([*key, *columns]))


def differing_ranges(a: DataFrame, b: DataFrame, bits: int = BITS) -> DataFrame:
    """(node) of the ranges whose digests differ, from range_digests() of both sides: a descent from the whole through nodes that differ, so that equal tables are told by one row each."""

    def level(df: DataFrame, down: int) -> DataFrame:
        up = df.withColumn("node", F.shiftright("node", bits - down))
        return up.groupBy("node").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.bit_xor("mix").alias("mix"))

    found = None
    for down in [*range(0, bits, STEP), bits]:
        x, y = level(a, down), level(b, down).select("node", F.col("n").alias("m"), F.col("sum").alias("sum2"), F.col("mix").alias("mix2"))
        if found is not None:
            above = found.select(F.col("node").alias("above"))
            x, y = (df.join(F.broadcast(above), F.shiftright("node", down - last) == F.col("above"), "left_semi") for df in (x, y))
        same = F.col("n").eqNullSafe(F.col("m")) & F.col("sum").eqNullSafe(F.col("sum2")) & F.col("mix").eqNullSafe(F.col("mix2"))
        found, last = cut(x.join(y, "node", "full_outer").filter(~same).select("node")), down
        if found.isEmpty():
            break
    return found


def sync_plan(source: DataFrame, mirror: DataFrame, key: list[str], columns: list[str], bits: int = BITS) -> DataFrame:
    """key, action of the keys that a mirror must delete, insert or update to have the source's rows; keys that are alike have no row.

    Both sides are read for digests, which are all that is shuffled where nothing differs. Only rows of ranges that differ meet by key, as narrow hashes. A key that repeats
    stands for all its rows; null is a key like others.
    """
    a, b = (cut(range_digests(df, key, columns, bits)) for df in (source, mirror))
    ranges = differing_ranges(a, b, bits)
    if ranges.isEmpty():
        return source.select(*key).withColumn("action", F.lit("")).limit(0)

    def rows(df: DataFrame, name: str) -> DataFrame:
        near = df.withColumn("_node", _leaf(key, bits)).join(F.broadcast(ranges.withColumnRenamed("node", "_node")), "_node", "left_semi")
        whole = near.groupBy(*(F.col(k).alias(f"{name}{i}") for i, k in enumerate(key))).agg(F.struct(*_digest(columns)).alias(name))
        return whole

    s, m = rows(source, "_s"), rows(mirror, "_m")
    met = reduce(lambda x, y: x & y, [F.col(f"_s{i}").eqNullSafe(F.col(f"_m{i}")) for i in range(len(key))])
    both = s.join(m, met, "full_outer").filter(~F.col("_s").eqNullSafe(F.col("_m")))
    action = F.when(F.col("_s").isNull(), "delete").when(F.col("_m").isNull(), "insert").otherwise("update")
    return both.select(*(F.when(F.col("_s").isNull(), F.col(f"_m{i}")).otherwise(F.col(f"_s{i}")).alias(k) for i, k in enumerate(key)), action.alias("action"))
