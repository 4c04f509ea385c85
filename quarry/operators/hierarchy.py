"""Chains of parents of any length, followed by doubling steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def chain_ends(links: DataFrame) -> DataFrame:
    """(id, end, cyclic) for every id of links (id, parent): the last id that following parents leads to, which has no link itself.

    Each round replaces a pointer by its target's pointer, so that a chain of n links takes log2(n) rounds; ids that are through take no part in later ones.
    An acyclic rest has ids of every depth, so that some get through in each round: when none does, all that are left are on cycles or lead to one, and have a null end.
    An id with several parents follows the least; ids and parents that are null have no link. Every round is cut; only (id, pointer) is shuffled.
    """
    fine = links.filter("id is not null and parent is not null")
    pointers = fine.groupBy("id").agg(F.min("parent").alias("at"))
    ids = fine.select(F.col("id").alias("at")).distinct().withColumn("_on", F.lit(True))
    state = cut(pointers.join(ids, "at", "left").select("id", "at", F.coalesce("_on", F.lit(False)).alias("on")))
    open_ = state.filter("on").count()
    while open_:
        target = state.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("on").alias("next_on"))
        moved = state.filter("on").select("id", "at").join(target, "at").select("id", F.col("next").alias("at"), F.col("next_on").alias("on"))
        state = cut(moved.unionByName(state.filter("not on")))
        before, open_ = open_, state.filter("on").count()
        if before == open_:
            break
    return state.select("id", F.when(~F.col("on"), F.col("at")).alias("end"), F.col("on").alias("cyclic"))


def inherited(rows: DataFrame, parent: str, own: str, out: str) -> DataFrame:
    """rows (with id, unique) with a column out: the value that the row at the end of its chain of parents has in own.

    A row without a parent, with one that is not in rows, or whose parents form a cycle has its own value; a chain ends at a row whose parent is not in rows.
    """
    there = rows.select(F.col("id").alias("parent"))
    links = rows.select("id", F.col(parent).alias("parent")).join(there, "parent", "left_semi")
    ends = chain_ends(links).filter("not cyclic").select("id", F.col("end").alias("_end"))
    values = rows.select(F.col("id").alias("_end"), F.col(own).alias("_value"), F.lit(True).alias("_there"))
    found = ends.join(values, "_end").select("id", "_value", "_there")
    return rows.join(found, "id", "left").withColumn(out, F.when(F.col("_there"), F.col("_value")).otherwise(F.col(own))).drop("_value", "_there")
