"""Queries of scans, summaries and small reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import severity as V
from ..operators import curate, transforms, weights
from ..sources import relations as R
from ..sources import tables
from .corpus import TARGET_SQL
from .curation import code_rows
from .registry import query

WITH = "WITH " + R.SAMPLES_SQL
LABEL_ROWS = ", ".join(f"({i}, '{c}')" for i, c in enumerate(K.LABELS))


@query(f"""{WITH}, o(position, cwe) AS (VALUES {LABEL_ROWS}), c AS (SELECT position, o.cwe, count(s.cwe) AS n FROM o LEFT JOIN v_samples s ON s.cwe = o.cwe AND s.doc_id % 8 < 5 GROUP BY ALL),
w AS (SELECT *, CASE WHEN n > 0 THEN (1 - 0.999::DOUBLE) / (1 - pow(0.999::DOUBLE, n)) ELSE 0 END AS raw, 1 / pow(greatest(n, 1)::DOUBLE, 0.25::DOUBLE) AS m FROM c),
e AS (SELECT position, cwe, n, raw * count(*) OVER () / sum(raw) OVER () AS weight, m * 0.5 / max(m) OVER () AS margin FROM w)
SELECT position, cwe, n, 'uniform' AS phase, 0 AS first_epoch, 8 AS n_epochs, 1.0::DOUBLE AS weight, round(margin, 9) AS margin FROM e
UNION ALL SELECT position, cwe, n, 'effective_number', 8, 2, round(weight, 9), round(margin, 9) FROM e""")
def weight_schedule(spark, d):
    """Weights of all labels in two phases; three of them have no rows."""
    counts = weights.class_counts(R.samples(spark, d, False).filter("doc_id % 8 < 5"))
    return weights.weight_schedule(spark, counts).withColumns({"weight": F.round("weight", 9), "margin": F.round("margin", 9)})


@query(f"""WITH {TARGET_SQL}, k AS (SELECT t.*, coalesce(length(v.cvss_vector) > 30, false) AS whole, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN 'h' || (o_orderkey % 100) WHEN o_orderkey % 4 = 1 THEN '' END, '') AS h
  FROM targets t JOIN v_cvss v USING (id) JOIN orders ON 'order_' || o_orderkey = id)
SELECT 'total' AS what, 'all' AS key, count(DISTINCT CASE WHEN h <> '' THEN h ELSE id END) AS n FROM k UNION ALL SELECT 'score_coverage', 'all', count(score) FROM k UNION ALL SELECT 'subvector_coverage', 'all', count(*) FILTER (WHERE whole) FROM k
UNION ALL SELECT 'score_source', score_source, count(*) FROM k GROUP BY score_source UNION ALL SELECT 'confidence', confidence, count(*) FROM k GROUP BY confidence""")
def target_summary(spark, d):
    """Severity targets by distinct contents, some of which many rows share, and by rows."""
    rows, letters = V.with_parts(R.cvss_rows(spark, d), "cvss_vector")
    key = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    content = F.when(key % 4 == 0, F.concat(F.lit("h"), (key % 100).cast("string"))).when(key % 4 == 1, "")
    t = V.target(F.col("cvss_vector"), F.col("cvss_score"), F.col("cvss_severity"), F.col("label_confidence"), letters)
    whole = F.coalesce(V.is_whole(F.col("cvss_vector"), letters), F.lit(False))
    return weights.target_summary(rows.select("id", content.alias("content_hash"), whole.alias("whole"), *(c.alias(k) for k, c in t.items())))


@query(f"{WITH} SELECT id, cwe FROM v_samples WHERE cwe <> ''")
def label_scan(spark, d):
    return tables.label_scan(R.samples(spark, d, False))


@query(f"WITH {R.CVSS_SQL} SELECT id, cvss_score::DOUBLE AS score FROM v_cvss WHERE cvss_score > 0")
def score_scan(spark, d):
    return tables.score_scan(R.cvss_rows(spark, d))


@query(f"{WITH} SELECT id, cwe, repo FROM v_samples WHERE is_hard_negative ORDER BY cwe, id LIMIT 20")
def preview_rows(spark, d):
    """The first 20 hard negatives, as a report shows them."""
    rows = R.samples(spark, d, False).filter("is_hard_negative").select("id", "cwe", "repo")
    return tables.preview(rows, ["cwe", "id"], 20)


@query(f"WITH {R.PREDICTIONS_SQL} SELECT tool, variant, sample_id, ground_truth, array_to_string(predicted, '|') AS predicted, 0 AS latency_ms FROM v_predictions")
def record_round_trip(spark, d):
    """Prediction records written as lines of JSON, without their empty lists, and read back with defaults."""
    rows = R.predictions(spark, d).withColumn("predicted", F.when(F.size("predicted") > 0, F.col("predicted")))
    back = tables.decode_records(tables.encode_records(rows))
    return back.select("tool", "variant", "sample_id", "ground_truth", F.array_join("predicted", "|").alias("predicted"), "latency_ms")


@query("""WITH a AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL AND doc_id % 2 = 0 GROUP BY source), b AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL AND n_chars > 5000 GROUP BY source)
SELECT source, coalesce(a.n, 0) AS even, coalesce(b.n, 0) AS long FROM a FULL OUTER JOIN b USING (source)""")
def report_beside(spark, d):
    """Counts of two sets of documents by source, for every source that either has."""
    docs = R.read(spark, d, "documents").select("source", "doc_id", "n_chars")
    return curate.report_beside({"even": docs.filter("doc_id % 2 = 0"), "long": docs.filter("n_chars > 5000")}, "source")


@query()
def twin_counters(spark, d):
    """Counts of safe twins by class, rule and reason."""
    rows = code_rows(spark, d).select("id", "code", "cwe", F.lit("r").alias("repo"), "cve_id")
    none = rows.filter("false").select(F.col("id").alias("parent_sample_id"))
    return transforms.twin_counters(transforms.hard_negatives(rows, none))
