"""Severity vectors and scores as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K

KEYS = list(K.CVSS_LETTERS)


def parts(vector: Column) -> dict[str, Column]:
    """One metric's letter(s) each, null without any; of a repeated metric the last counts."""
    return {k: F.nullif(F.regexp_extract(vector, f"(?:.*/|^){k}:([^/]*)", 1), F.lit("")) for k in KEYS}


def with_parts(df: DataFrame, vector: str, prefix: str = "_m") -> tuple[DataFrame, dict[str, Column]]:
    """df with a column for each metric of a vector, and these columns, so that what uses them often reads the vector once."""
    return df.withColumns({f"{prefix}{k}": v for k, v in parts(F.col(vector)).items()}), {k: F.col(f"{prefix}{k}") for k in KEYS}


def words(vector: Column) -> dict[str, Column]:
    """The metrics spelled out; unknown letters give null."""
    return {k: F.try_element_at(F.create_map(*(F.lit(x) for kv in K.CVSS_WORDS[k].items() for x in kv)), v) for k, v in parts(vector).items()}


def is_whole(vector: Column, letters: dict[str, Column] | None = None) -> Column:
    """Whether it is a 3.0 or 3.1 vector with a valid letter for every metric; letters: its parts, if they are columns already."""
    fine = [F.coalesce(v.isin(*K.CVSS_LETTERS[k]), F.lit(False)) for k, v in (letters or parts(vector)).items()]
    return F.coalesce(vector.rlike(r"^CVSS:3\.[01]/"), F.lit(False)) & reduce(lambda a, b: a & b, fine)


def subvectors(vector: Column) -> Column:
    return F.when(is_whole(vector), F.create_map(*(x for k, v in parts(vector).items() for x in (F.lit(k), v))))


def _weight(letter: Column, table: dict[str, float]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), letter), F.lit(0.0))


def base_score(letters: dict[str, Column]) -> Column:
    """The CVSS 3.1 base score of metric letters; an unknown letter weighs 0, and an unknown scope is U."""
    changed = F.coalesce(letters["S"] == "C", F.lit(False))
    w = {k: _weight(letters[k], K.CVSS_WEIGHTS[k]) for k in K.CVSS_WEIGHTS}
    privileges = F.when(changed, _weight(letters["PR"], K.CVSS_PRIVILEGES["C"])).otherwise(_weight(letters["PR"], K.CVSS_PRIVILEGES["U"]))
    iss = 1 - (1 - w["C"]) * (1 - w["I"]) * (1 - w["A"])
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15.0))).otherwise(6.42 * iss)
    reach = 8.22 * w["AV"] * w["AC"] * privileges * w["UI"]
    raw = F.least(F.when(changed, 1.08 * (impact + reach)).otherwise(impact + reach), F.lit(10.0))
    return F.when(impact <= 0, F.lit(0.0)).otherwise(F.ceil(raw * 10) / F.lit(10.0))


def vector_score(vector: Column, letters: dict[str, Column] | None = None) -> Column:
    """The score of a whole vector, else null."""
    return F.when(is_whole(vector, letters), base_score(letters or parts(vector)))


def lenient_score(vector: Column) -> Column:
    """The score of any vector with metrics that are missing weighing 0; null for null."""
    return F.when(vector.isNotNull(), base_score(parts(vector)))


def midpoint(severity: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in K.MIDPOINTS.items() for x in kv)), F.upper(F.trim(severity)))


def band(score: Column) -> Column:
    return F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").when(score.isNotNull(), "LOW")


def target(vector: Column, score: Column, severity: Column, confidence: Column, letters: dict[str, Column] | None = None) -> dict[str, Column]:
    """Score, where it is from, confidence and loss weight of a regression target."""
    whole, own, mid = is_whole(vector, letters), score.isNotNull(), midpoint(severity)
    origin = F.when(whole & own, "advisory").when(whole, "computed_from_vector").when(own, "advisory_score_only").when(mid.isNotNull(), "band_midpoint").otherwise("missing")
    value = F.coalesce(score, vector_score(vector, letters), mid)
    sure = F.when(origin == "missing", "low").when((origin == "band_midpoint") & (confidence == "high"), "medium").otherwise(confidence)
    weight = F.when(origin == "missing", 0.0).otherwise(_weight(sure, K.CONFIDENCE_WEIGHTS))
    return {"score": value, "score_source": origin, "confidence": sure, "loss_weight": weight}
