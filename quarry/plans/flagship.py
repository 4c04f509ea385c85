"""The flagship query: deduplicate, gate, split, and score per class, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curate, metrics, split, stages
from ..sources import relations as R
from ..sources.snippets import snippets


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cwe, train, val, test (rows that survive deduplication and the gate), f1 (of tool0 on the clean variant)."""
    rows = snippets(spark, sf_dir)
    kept = curate.dedup_by_hash(rows).filter("kept").select("id", "doc_id", "cwe")
    passed = stages.refilter(rows).filter("reason is null").select("doc_id")
    placed = split.stratified_split(kept.join(passed, "doc_id").select("id", "cwe"))
    scores = metrics.class_scores(metrics.confusion(R.predictions(spark, sf_dir).filter("tool = 'tool0' and variant = 'clean'")))
    return split.cross_tab(placed, "cwe").join(scores.select("cwe", F.round("f1", 9).alias("f1")), "cwe", "left")
