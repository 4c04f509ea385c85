"""Folds and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, sized_join

#: Fixed values of the fold rule: crc32(doc_id as text) mod 4, of which remainder 2 is held out.
FOLDS, HELD_OUT = 4, 2
#: Ranges of id hashes that rows are counted in, to find where a class has enough of them.
RANGES = 1 << 16


def held_out(doc_id: Column) -> Column:
    """Whether a document is held out of learning; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def learning_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, y, total, text) of at most per_class documents of each class: those of least hash of their id. total: documents of the class that could be chosen.

    docs: doc_id, text; labels: doc_id, y. Held-out documents, and rows without id or label, are left out. An id
    with several labels counts with the greatest, one with several texts with the least.
    """
    fine = labels.filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    single = fine.groupBy("doc_id").agg(F.max("y").alias("y"))
    ids = docs.filter("doc_id is not null").select("doc_id").distinct()
    there = cut(single.join(ids, "doc_id", "left_semi").withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(RANGES))))
    # rows are counted by range first, so that only the ranges that are needed are ranked, not a whole class in one task
    until = F.sum("n").over(Window.partitionBy("y").orderBy("h"))
    counts = there.groupBy("y", "h").agg(F.count(F.lit(1)).alias("n")).withColumn("before", until - F.col("n"))
    needed = F.max(F.when(F.col("before") < per_class, F.col("h")))
    last = cut(counts.groupBy("y").agg(needed.alias("last"), F.sum("n").alias("total")))
    order = Window.partitionBy("y").orderBy("h", F.xxhash64("doc_id"), "doc_id")
    near = sized_join(there, last, "y", "inner", 64).filter(F.col("h") <= F.col("last"))
    chosen = cut(near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_class).select("doc_id", "y", "total"))
    texts = sized_join(docs.select("doc_id", "text"), chosen, "doc_id", "inner", 64)
    return texts.groupBy("doc_id").agg(F.first("y").alias("y"), F.first("total").alias("total"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
