"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the least node of its component.

    Each round links neighbours above a node, then neighbours below it, to the least neighbour, which halves paths; only minima per node are
    aggregated, so a node with very many neighbours is no burden. Every round is cut. No edges give no rows.
    """
    e = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        # every larger neighbour of u to the least of u and its neighbours
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = cut(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # u and all its smaller neighbours to the least of them
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(e)
        if before == state:
            break
    if not state[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    star = e.groupBy("u").agg(F.min("v").alias("v"))
    roots = star.select("v").distinct()
    return cut(star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root"))))
