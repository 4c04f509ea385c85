"""Detectors by name: each turns its tool's raw reports into sorted predicted classes of samples, and all into records of one shape.

A report is a row (sample_id, report). A detector is a column of the report that gives an array of classes, so that reports are parsed where they are read, without Python;
tools that must be run go through streaming.incremental.evaluate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .advisory import SARIF_REPORT, SCAN_REPORT, rule_classes

DETECTORS: dict[str, Callable[[Column], Column]] = {}


def detector(name: str):
    def add(f):
        DETECTORS[name] = f
        return f

    return add


@detector("rules")
def rule_report(report: Column) -> Column:
    """A scanner's findings with rule numbers."""
    return F.array_compact(F.transform(F.from_json(report, SCAN_REPORT)["results"], lambda r: X.rule_class(r.test_id)))


@detector("sarif")
def sarif_report(report: Column) -> Column:
    """Results in the SARIF format, by the tags and the class lists of their rules."""
    runs = F.from_json(report, SARIF_REPORT)["runs"]
    hit = lambda run, rule: F.exists(run.results, lambda x: x.ruleId == rule.id)
    return F.flatten(F.transform(runs, lambda run: F.flatten(F.transform(F.filter(run.tool.driver.rules, lambda rule: hit(run, rule)), lambda rule: rule_classes(rule.properties)))))


@detector("verdict")
def model_answer(report: Column) -> Column:
    """A model's answer in words."""
    return X.parse_response(X.strip_thinking(report))


def records(samples: DataFrame, reports: DataFrame, name: str, version: str) -> DataFrame:
    """One record per sample (sample_id, ground_truth): tool, tool_version, predicted; several reports of a sample add up, a sample without one predicts nothing."""
    if name not in DETECTORS:
        raise ValueError(f"unknown detector {name}; there are {sorted(DETECTORS)}")
    found = reports.select("sample_id", F.explode(DETECTORS[name](F.col("report"))).alias("cwe")).groupBy("sample_id").agg(F.collect_set("cwe").alias("predicted"))
    said = F.array_sort(F.coalesce("predicted", F.array().cast("array<string>")))
    return samples.select("sample_id", "ground_truth").join(found, "sample_id", "left").select(F.lit(name).alias("tool"), F.lit(version).alias("tool_version"), "sample_id", "ground_truth", said.alias("predicted"))


def score_codes(codes: Column, letters: dict[str, str]) -> Column:
    """A vector text of predicted option numbers, one for each metric in order; null if a number is out of range."""
    parts = [F.concat(F.lit(f"{k}:"), F.try_element_at(F.split(F.lit(v), ""), codes[i] + 1)) for i, (k, v) in enumerate(letters.items())]
    return F.when(F.forall(F.array(*parts), lambda p: p.isNotNull()), F.concat_ws("/", F.lit("CVSS:3.1"), *parts))
