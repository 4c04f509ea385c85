"""A training-corpus pipeline of five stages: quality, near duplicates, repeated strings, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import decontaminate, jaccard_join, mixing, quality, suffix_dedup
from quarry.llm.queries import MIX_WEIGHTS, mix_levels
from quarry.llm.shared import columns, cut, free_prefix, sized_join, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score 0.7 or more)."""
    p = free_prefix(docs)
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, forest, keep=tuple(docs.columns), prefix=p).filter(F.col(f"{p}score") >= 0.7).select(*columns(docs))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the least doc_id, of each group that 5-word shingles of similarity 0.8 or more link.

    Rows that repeat an id with other texts are documents of their own; of rows that repeat id and text one stays. Rows without an id are in no group and stay.
    """
    p = free_prefix(docs)
    key = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("text")))
    rows = docs.withColumn(f"{p}key", key)
    groups = cut(jaccard_join.near_duplicates(rows, n=5, percent=80, doc_id=f"{p}key"))
    gone = cut(groups.filter("component_id <> doc_id").select(F.col("doc_id").alias(f"{p}key")).distinct())
    kept = sized_join(rows, gone, f"{p}key", "left_anti", 24)
    several = cut(groups.filter("doc_id is not null").groupBy(F.col("doc_id").alias(f"{p}key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(f"{p}key"))
    if several.isEmpty():
        return kept.select(*columns(docs))
    first = Window.partitionBy(f"{p}key").orderBy(*columns(docs, "text"))
    again = sized_join(kept, several, f"{p}key", "left_semi", 24).select(F.struct(*columns(docs)).alias("r"), F.row_number().over(first).alias("n")).filter("n = 1").select("r.*")
    return sized_join(kept, several, f"{p}key", "left_anti", 24).select(*columns(docs)).unionByName(again)


#: Words of a passage that is removed wherever it stands, if it stands twice.
PASSAGE_WORDS = 50


def repeated_string_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their passages of 50 words that stand elsewhere too; one that loses its whole text goes."""
    p = free_prefix(docs)
    out = suffix_dedup.remove_repeats(docs, length=PASSAGE_WORDS, unit="words", keep=tuple(c for c in docs.columns if c != "text"), with_text=True, prefix=p)
    removed = F.col(f"{p}n_removed")
    left = out.filter((removed == 0) | (F.trim(F.coalesce(f"{p}kept", F.lit(""))) != "")).withColumnRenamed(f"{p}kept", "text")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(removed > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*columns(docs))


def decontamination_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a 10-word window of a benchmark item."""
    p = free_prefix(docs)
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), size=10, keep=tuple(docs.columns), prefix=p)
    return found.filter(F.col(f"{p}n_hit") == 0).select(*columns(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents and epochs of a mix of half of all tokens by domain, language and source."""
    p = free_prefix(docs)
    mixed = mixing.mix(docs, mix_levels(), MIX_WEIGHTS, fraction=0.5, max_epochs=2, seed=1, prefix=p)
    made = [m for m in ("epoch", "n_tokens", "used_tokens") if m not in docs.columns]
    return mixed.select(*columns(docs), *(F.col(f"{p}{m}").alias(m) for m in made))


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicate_filter", near_duplicate_filter),
    ("repeated_string_filter", repeated_string_filter),
    ("decontamination_filter", decontamination_filter),
    ("source_mix", source_mix),
]

#: SQL expresses neither the classifier nor the removal of repeated strings; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
