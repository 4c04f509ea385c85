"""Small constant relations with published results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def frame(spark: SparkSession, ddl: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


FULL = "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"
VECTORS = [
    (FULL, 9.8, 9.8),
    (FULL.replace("S:U", "S:C"), 10.0, 10.0),
    ("CVSS:3.0/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", 0.0, 0.0),
    ("CVSS:3.1/AV:N/AC:L", None, 0.0),
    (FULL.replace("AV:N", "AV:X"), None, 5.9),
    (FULL.removeprefix("CVSS:3.1/"), None, 9.8),
    ("CVSS:3.1/AV:L/AC:H/PR:H/UI:R/S:U/C:L/I:N/A:N", 1.8, 1.8),
    ("", None, 0.0),
    (None, None, None),
]
GOLD_DDL = "tool string, variant string, sample_id string, ground_truth string, predicted array<string>"
#: five records whose scores are published: macro F1 0.5, hierarchical accuracy 0.41667, kappa 0.16667, agreement 0.4
GOLD = [
    ("g", "clean", "a", "CWE-79", ["CWE-79"]),
    ("g", "clean", "b", "CWE-79", []),
    ("g", "clean", "c", "CWE-79", ["CWE-22"]),
    ("g", "clean", "d", "CWE-22", []),
    ("g", "clean", "e", "CWE-22", ["CWE-22"]),
]
