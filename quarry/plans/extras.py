"""Queries: keys and seeds, reports, lookups, audit pages, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import severity as V
from ..functions import text as X
from ..operators import advisory, metrics, split, weights
from ..sources import relations as R
from ..sources import snippets as C
from ..sources import tables
from .registry import query

WITH = "WITH " + R.SAMPLES_SQL


@query(f"{WITH} SELECT id, ('0x' || substr(sha256(id || ':3'), 1, 8))::BIGINT AS seed, row_number() OVER (ORDER BY sha256('42:' || id), id) AS position FROM v_samples")
def seeded_order(spark, d):
    """Seeds and a seeded order of all rows: ranks come from counts per key prefix, so that no task sorts everything."""
    rows = R.samples(spark, d, False).select("id", X.stable_seed(F.col("id"), F.lit("3")).alias("seed"), split.seeded(42, F.col("id")).alias("o"))
    from pyspark.sql import Window

    rows = rows.withColumn("bucket", F.substring("o", 1, 2))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("o", "id"))
    return rows.join(F.broadcast(before), "bucket").select("id", "seed", (F.col("before") + rank).alias("position"))


@query(f"{WITH} SELECT id, sha256(CASE WHEN length(code) > 80 THEN split_part(code, ':', 1) ELSE code END) AS reason_sha FROM v_samples")
def skip_reasons(spark, d):
    return R.samples(spark, d).select("id", F.sha2(X.skip_reason(F.col("code")), 256).alias("reason_sha"))


@query()
def audit_pages(spark, d):
    """Markdown of five sampled rows of each class with an excerpt of the first line."""
    rows = split.sample_per_class(R.samples(spark, d), 5)
    shown = rows.select("id", "cwe", "source", F.lit(1).alias("line"), F.lit(None).cast("string").alias("pattern"), X.excerpt(F.col("code"), F.lit(1), 2).alias("excerpt"))
    return advisory.audit_pages(shown)


@query(f"WITH {R.PREDICTIONS_SQL} SELECT DISTINCT sample_id FROM v_predictions WHERE variant = 'clean' AND len(predicted) > 0")
def scored_ids(spark, d):
    return R.predictions(spark, d).filter((F.col("variant") == "clean") & (F.size("predicted") > 0)).select("sample_id").distinct()


@query(f"""{WITH} SELECT cwe, framework, source, grouping_id(cwe, framework, source)::BIGINT AS level, count(*) AS n, count(*) FILTER (WHERE is_hard_negative) AS n_hard FROM v_samples GROUP BY CUBE (cwe, framework, source)""")
def count_cube(spark, d):
    rows = R.samples(spark, d, False)
    return rows.cube("cwe", "framework", "source").agg(F.grouping_id("cwe", "framework", "source").alias("level"), F.count(F.lit(1)).alias("n"), F.count_if("is_hard_negative").alias("n_hard"))


@query("""WITH e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), m AS (SELECT id, label, list_transform(v, lambda x, i: (CASE WHEN i = label + 1 THEN x - 0.01::DOUBLE * i ELSE x END) * 30) AS z FROM e)
SELECT id, round(ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) + list_max(z) - z[label + 1], 6) AS loss FROM m""")
def ldam_losses(spark, d):
    """The whole vectors are the logits, so that every label has one."""
    e = R.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    margins = F.transform("v", lambda x, i: F.lit(0.01) * (i + 1))
    return e.select("id", F.round(weights.ldam_loss(F.col("v"), F.col("label"), margins), 6).alias("loss"))


@query("""WITH e AS (SELECT vec_id AS id, vec_id // 16 AS batch, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT id, batch, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e),
p AS (SELECT a.batch, a.id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / 0.07::DOUBLE AS s FROM u a JOIN u b ON a.batch = b.batch AND a.id <> b.id),
t AS (SELECT batch, id, ln(sum(exp(s))) AS l, avg(s) FILTER (WHERE same) AS m FROM p GROUP BY batch, id) SELECT batch, round(avg(l - m), 6) AS loss FROM t WHERE m IS NOT NULL GROUP BY batch""")
def supcon_losses(spark, d):
    e = R.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 16).cast("long").alias("batch"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return weights.supcon_loss(e).withColumn("loss", F.round("loss", 6))


@query("WITH " + R.SAMPLES_SQL + ", " + R.values_sql("c", "node, ups", [(c, v) for c, v in sorted(metrics._depths()[0].items())]) + """, b AS (SELECT node, count(*) AS n FROM (SELECT unnest(ups) AS node FROM c JOIN v_samples ON cwe = 'CWE-' || c.node) GROUP BY node)
SELECT c.node, len(ups) - 1 AS n_up, coalesce(b.n, 0) AS n_samples FROM c LEFT JOIN b USING (node)""")
def tree_ancestors(spark, d):
    """How many ancestors each class of the tree has, and how many samples are of it or of a class below it, by a recursive query."""
    up = metrics.tree_closure(spark)
    own = R.samples(spark, d, False).groupBy("cwe").agg(F.count(F.lit(1)).alias("own")).select(F.replace("cwe", F.lit("CWE-")).alias("node"), "own")
    below = up.join(own, "node").groupBy("ancestor").agg(F.sum("own").alias("n_samples")).withColumnRenamed("ancestor", "node")
    counted = up.filter("up > 0").groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("n_up"))
    return counted.join(below, "node", "left").select("node", "n_up", F.coalesce("n_samples", F.lit(0)).alias("n_samples"))


# training tables


LETTERS_SQL = ", ".join(f"CASE WHEN w THEN coalesce(nullif(strpos('{v}', regexp_extract(cvss_vector, '(^|/){k}:([A-Z])', 2)), 0) - 1, {K.IGNORE_INDEX}) ELSE {K.IGNORE_INDEX} END" for k, v in K.CVSS_LETTERS.items())


@query(f"""WITH {C.SNIPPETS_SQL}, {R.CVSS_SQL}, t AS (SELECT replace(id, 'order_', 'doc_') AS key, cvss_vector, coalesce(length(cvss_vector) > 30, false) AS w, cvss_score FROM v_cvss),
r AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN substr(sha256(code), 1, 16) ELSE id END AS key FROM v_snippets)
SELECT r.id AS sample_id, list_position({R._list(K.LABELS)}, cwe)::INT - 1 AS class_index, array_to_string(CASE WHEN t.key IS NULL THEN list_transform(range(8), lambda x: {K.IGNORE_INDEX}) ELSE [{LETTERS_SQL}] END, ',') AS sub_labels,
coalesce(cvss_score, 'nan'::DOUBLE) AS cvss_score, CASE WHEN t.key IS NULL THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS loss_weight, is_hard_negative FROM r LEFT JOIN t ON t.key = r.key""")
def training_examples(spark, d):
    """Class index, labels of the eight metrics, score and weight of each program; a third is looked up by a content hash that has no target."""
    rows = C.snippets(spark, d)
    rows = rows.select("id", "cwe", "is_hard_negative", F.when(F.col("doc_id") % 3 == 0, X.code_hash(F.col("code"))).alias("content_hash"))
    scored, letters = V.with_parts(R.cvss_rows(spark, d), "cvss_vector")
    whole = V.is_whole(F.col("cvss_vector"), letters)
    targets = scored.select(F.replace("id", F.lit("order_"), F.lit("doc_")).alias("key"), F.when(whole, F.struct(*(v.alias(k) for k, v in letters.items()))).alias("letters"), F.col("cvss_score").alias("score"), F.lit(0.5).alias("loss_weight"))
    return weights.training_examples(rows, targets).withColumn("sub_labels", F.array_join(F.transform("sub_labels", lambda x: x.cast("string")), ","))


@query("SELECT vec_id AS id, round(0.5 * exp(-(embedding[1]::DOUBLE)) * pow(label - embedding[2]::DOUBLE, 2) + 0.5 * embedding[1]::DOUBLE, 6) AS nll FROM embeddings WHERE embedding IS NOT NULL")
def gaussian_losses(spark, d):
    """Heteroscedastic losses with the first component as log variance and the second as mean."""
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return R.read(spark, d, "embeddings").filter("embedding is not null").select(F.col("vec_id").alias("id"), F.round(weights.nll(v(1), v(0), F.col("label")), 6).alias("nll"))


@query(f"""{WITH}, w AS (SELECT id, [1.0, 2.0, 4.0, 8.0][(doc_id % 4 + 1)::INT]::DOUBLE AS weight FROM v_samples), c AS (SELECT id, weight, sum(weight) OVER (ORDER BY sha256(id), id) AS hi FROM w),
d AS (SELECT ('0x' || substr(sha256('7:' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * (SELECT sum(weight) FROM w) AS u FROM (SELECT unnest(range(2000)) AS j))
SELECT id, count(*) AS times FROM c JOIN d ON u >= hi - weight AND u < hi GROUP BY id""")
def balanced_draws(spark, d):
    """2000 draws with replacement by weight."""
    weight = F.element_at(F.array(*map(F.lit, [1.0, 2.0, 4.0, 8.0])), (F.col("doc_id") % 4 + 1).cast("int"))
    return weights.draws_with_replacement(R.samples(spark, d, False).select("id", weight.alias("weight")), 2000, 7)


# projected scans


@query(f"{WITH} SELECT id, cwe, repo, framework, source, is_hard_negative, parent_sample_id FROM v_samples")
def split_inputs(spark, d):
    """The columns that a split needs; no text is read."""
    return tables.split_inputs(R.samples(spark, d))


@query(f"WITH {C.SNIPPETS_SQL} SELECT id, substr(sha256(code), 1, 16) AS content_hash, cwe, cve_id FROM v_snippets WHERE cve_id IS NOT NULL AND cve_id <> '' AND cwe NOT IN ('safe', '')")
def enrichable_rows(spark, d):
    """Rows that have a class and an advisory."""
    rows = C.snippets(spark, d).withColumn("content_hash", X.code_hash(F.col("code")))
    return tables.present(rows, ["cve_id", "cwe"]).filter("cwe <> 'safe'").select("id", "content_hash", "cwe", "cve_id")
