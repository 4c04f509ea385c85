"""Domain relations derived from the benchmark tables by arithmetic on keys, for runs at any scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K

TOOLS = ["tool0", "tool1", "tool2"]
DERIVED_VARIANTS = ["clean", "dead_code_injection", "string_split"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label(index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, K.LABELS)), (index + 1).cast("int"))


def samples(spark: SparkSession, sf_dir: str, with_code: bool = True) -> DataFrame:
    """Corpus rows from documents: skewed repositories, orphan and parented hard negatives, capped groups."""
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    repo = F.when(i % 5 == 0, None).when(i % 7 == 0, F.concat(F.lit("big"), (i % 3).cast("string"))).otherwise(F.concat(F.lit("r"), (i * i % 997).cast("string")))
    return d.select(
        F.concat(F.lit("doc_"), i.cast("string")).alias("id"),
        i.alias("doc_id"),
        *([F.col("text").alias("code")] if with_code else []),
        label(i % 8).alias("cwe"),
        repo.alias("repo"),
        F.col("lang").alias("framework"),
        "source",
        (i % 8 == 7).alias("is_hard_negative"),
        F.when(i % 8 == 7, F.concat(F.lit("doc_"), (i - 1).cast("string"))).alias("parent_sample_id"),
        F.when(i % 4 != 0, F.concat(F.lit("CVE-"), (i % 13).cast("string"))).alias("cve_id"),
    )


def chained_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, cwe, repo, is_hard_negative, parent_sample_id of every document: chains of up to 96 parents, with orphans, rows that end a chain in its middle, and cycles."""
    d, i = read(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id")
    at = i % 97
    parent = F.when(at == 0, None).when(at == 40, "gone").when((at == 60) & (i % 2 == 0), F.concat(F.lit("doc_"), (i + 7).cast("string"))).otherwise(F.concat(F.lit("doc_"), (i - 1).cast("string")))
    repo = F.when(i % 3 != 0, F.concat(F.lit("r"), (i % 31).cast("string")))
    return d.select(F.concat(F.lit("doc_"), i.cast("string")).alias("id"), label(i % 8).alias("cwe"), repo.alias("repo"), (i % 29 != 0).alias("is_hard_negative"), parent.alias("parent_sample_id"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction records of three tools on three variants of every document."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    d = d.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(2))))
    i, k = F.col("doc_id"), F.col("doc_id") % 8
    hit = (i * 11 + F.col("t") * 3 + F.col("v")) % (F.col("v") + 5) < 3 - F.col("t") % 2
    first = F.when(hit, label(k)).when(i % 2 == 0, label((k + 3) % 8))
    second = F.when(i % 10 == 0, label((k + 1) % 8))
    said = F.array_sort(F.array_distinct(F.filter(F.array_compact(F.array(first, second)), lambda x: x != "safe")))
    return d.select(
        F.concat(F.lit("tool"), F.col("t").cast("string")).alias("tool"),
        F.element_at(F.array(*map(F.lit, DERIVED_VARIANTS)), F.col("v") + 1).alias("variant"),
        F.concat(F.lit("doc_"), i.cast("string")).alias("sample_id"),
        label(k).alias("ground_truth"),
        said.alias("predicted"),
    )


def cvss_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity inputs from orders: vectors by the digits of the key, some missing or broken."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    letters, base = [], 1
    for name, options in K.CVSS_LETTERS.items():
        digit = F.pmod(F.floor(k / base), F.lit(len(options)))
        letters += [F.concat(F.lit(f"{name}:"), F.substring(F.lit(options), (digit + 1).cast("int"), F.lit(1)))]
        base *= len(options)
    vector = F.when(k % 7 == 0, None).when(k % 11 == 0, F.lit("CVSS:3.1/AV:N/AC:L")).otherwise(F.concat_ws("/", F.lit("CVSS:3.1"), *letters))
    word = F.element_at(F.array(*map(F.lit, ["CRITICAL", "HIGH", "MEDIUM", "LOW", "MODERATE"])), F.substring("o_orderpriority", 1, 1).cast("int"))
    return o.select(
        F.concat(F.lit("order_"), k.cast("string")).alias("id"),
        vector.alias("cvss_vector"),
        F.when(k % 5 == 0, F.pmod(k, F.lit(100)) / 10.0).alias("cvss_score"),
        F.when(k % 3 != 0, word).alias("cvss_severity"),
        F.element_at(F.array(*map(F.lit, ["high", "medium", "low"])), (k % 3 + 1).cast("int")).alias("label_confidence"),
    )


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: The same relations in DuckDB SQL, as common table expressions.
SAMPLES_SQL = f"""v_samples AS (
  SELECT 'doc_' || doc_id AS id, doc_id, text AS code, ({_list(K.LABELS)})[(doc_id % 8 + 1)::INT] AS cwe,
         CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'big' || (doc_id % 3) ELSE 'r' || (doc_id * doc_id % 997) END AS repo,
         lang AS framework, source, doc_id % 8 = 7 AS is_hard_negative,
         CASE WHEN doc_id % 8 = 7 THEN 'doc_' || (doc_id - 1) END AS parent_sample_id,
         CASE WHEN doc_id % 4 <> 0 THEN 'CVE-' || (doc_id % 13) END AS cve_id
  FROM documents)"""

CHAINED_SQL = f"""v_chained AS (
  SELECT 'doc_' || doc_id AS id, ({_list(K.LABELS)})[(doc_id % 8 + 1)::INT] AS cwe, CASE WHEN doc_id % 3 <> 0 THEN 'r' || (doc_id % 31) END AS repo, doc_id % 29 <> 0 AS is_hard_negative,
         CASE WHEN doc_id % 97 = 0 THEN NULL WHEN doc_id % 97 = 40 THEN 'gone' WHEN doc_id % 97 = 60 AND doc_id % 2 = 0 THEN 'doc_' || (doc_id + 7) ELSE 'doc_' || (doc_id - 1) END AS parent_sample_id
  FROM documents)"""

PREDICTIONS_SQL = f"""v_raw AS (
  SELECT doc_id, t, v, ({_list(K.LABELS)})[(doc_id % 8 + 1)::INT] AS truth,
         CASE WHEN (doc_id * 11 + t * 3 + v) % (v + 5) < 3 - t % 2 THEN ({_list(K.LABELS)})[(doc_id % 8 + 1)::INT]
              WHEN doc_id % 2 = 0 THEN ({_list(K.LABELS)})[((doc_id % 8 + 3) % 8 + 1)::INT] END AS p1,
         CASE WHEN doc_id % 10 = 0 THEN ({_list(K.LABELS)})[((doc_id % 8 + 1) % 8 + 1)::INT] END AS p2
  FROM documents, (SELECT unnest([0, 1, 2]) AS t) a, (SELECT unnest([0, 1, 2]) AS v) b),
v_predictions AS (
  SELECT 'tool' || t AS tool, ({_list(DERIVED_VARIANTS)})[v + 1] AS variant, 'doc_' || doc_id AS sample_id, truth AS ground_truth,
         list_sort(list_distinct(list_filter([p1, p2], lambda x: x IS NOT NULL AND x <> 'safe'))) AS predicted
  FROM v_raw)"""


def _vector_sql() -> str:
    out, base = [], 1
    for name, options in K.CVSS_LETTERS.items():
        out.append(f"'{name}:' || substr('{options}', ((o_orderkey // {base}) % {len(options)} + 1)::INT, 1)")
        base *= len(options)
    return "'CVSS:3.1/' || " + " || '/' || ".join(out)


CVSS_SQL = f"""v_cvss AS (
  SELECT 'order_' || o_orderkey AS id,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'CVSS:3.1/AV:N/AC:L' ELSE {_vector_sql()} END AS cvss_vector,
         CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 100) / 10.0::DOUBLE END AS cvss_score,
         CASE WHEN o_orderkey % 3 <> 0 THEN (['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'MODERATE'])[substr(o_orderpriority, 1, 1)::INT] END AS cvss_severity,
         (['high', 'medium', 'low'])[(o_orderkey % 3 + 1)::INT] AS label_confidence
  FROM orders)"""


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, list):
        return "[" + ", ".join(map(literal, value)) + "]"
    return "'" + str(value).replace("'", "''") + "'"


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression of constant rows."""
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"
