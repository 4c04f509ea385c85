"""Queries over resumable evaluation, incremental ingestion and windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import code_hash
from ..operators import batches, intervals, mirror, skipsets
from ..operators.lineage import shared_folder
from ..sources import relations as R
from ..sources.snippets import snippets
from ..streaming import incremental
from .evaluation import WEIGHT_SQL
from .registry import query

WITH = "WITH " + R.PREDICTIONS_SQL


@query(f"""{WITH}, d AS (SELECT * FROM v_predictions WHERE variant = 'clean' OR (variant = 'string_split' AND tool <> 'tool2' AND right(sample_id, 1) <> '4')),
w AS (SELECT tool, variant, count(*) AS n_expected FROM v_predictions GROUP BY ALL), h AS (SELECT tool, variant, count(*) AS n FROM d GROUP BY ALL)
SELECT tool, variant, n_expected, coalesce(n, 0) AS n_done, CASE WHEN coalesce(n, 0) = n_expected THEN 'skip' WHEN coalesce(n, 0) > 0 THEN 'redo' ELSE 'run' END AS action FROM w LEFT JOIN h USING (tool, variant)""")
def resume_plan(spark, d):
    p = R.predictions(spark, d)
    done = p.filter((F.col("variant") == "clean") | ((F.col("variant") == "string_split") & (F.col("tool") != "tool2") & (F.substring("sample_id", -1, 1) != "4")))
    return incremental.resume_plan(p, done, ["tool", "variant"])


@query(f"""{WITH} SELECT s.sample_id, coalesce(array_to_string(p.predicted, '|'), '') AS predicted FROM (SELECT 'doc_' || doc_id AS sample_id FROM documents) s
LEFT JOIN (SELECT * FROM v_predictions WHERE tool = 'tool1' AND variant = 'clean' AND right(sample_id, 1) <> '2') p USING (sample_id)""")
def fill_missing(spark, d):
    p = R.predictions(spark, d).filter((F.col("tool") == "tool1") & (F.col("variant") == "clean") & (F.substring("sample_id", -1, 1) != "2"))
    samples = R.samples(spark, d, False).select(F.col("id").alias("sample_id"))
    return incremental.fill_missing(samples, p.select("sample_id", "predicted")).select("sample_id", F.array_join("predicted", "|").alias("predicted"))


@query("""SELECT DISTINCT substr(sha256(text), 1, 16) AS content_hash FROM documents d WHERE doc_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM documents k WHERE k.doc_id % 2 = 1 AND k.text = d.text)""")
def incremental_ingest(spark, d):
    """Contents of a new half of the documents that the other half has not, once each."""
    docs = R.read(spark, d, "documents").select("doc_id", code_hash(F.col("text")).alias("content_hash"))
    return incremental.new_rows(docs.filter("doc_id % 2 = 0").select("content_hash"), docs.filter("doc_id % 2 = 1"), "content_hash")


@query("""SELECT 'repo' || (doc_id % 97) AS repo, substr(sha256(text), 1, 16) AS sha, doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM documents k WHERE k.doc_id % 3 = 1 AND k.doc_id % 97 = documents.doc_id % 97 AND k.text = documents.text)""")
def skip_known_commits(spark, d):
    """Documents as files of repositories without those whose (repo, sha) a third of them has."""
    docs = R.read(spark, d, "documents").select(F.concat(F.lit("repo"), (F.col("doc_id") % 97).cast("string")).alias("repo"), code_hash(F.col("text")).alias("sha"), "doc_id")
    return skipsets.skip_known(docs, docs.filter("doc_id % 3 = 1"), ["repo", "sha"])


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_returnflag = 'R' AND k.l_orderkey = lineitem.l_orderkey AND k.l_suppkey % 7 = lineitem.l_suppkey % 7 AND k.l_partkey % 5 = lineitem.l_partkey % 5)""")
def skip_known_triples(spark, d):
    """Lines without those whose key of three parts a line sent back has."""
    rows = R.read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", (F.col("l_suppkey") % 7).alias("s"), (F.col("l_partkey") % 5).alias("p"))
    return skipsets.skip_known(rows, rows.filter("l_returnflag = 'R'"), ["l_orderkey", "s", "p"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("""SELECT DISTINCT substr(sha256(text), 1, 16) AS content_hash FROM documents d WHERE doc_id % 4 <> 0 AND text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents k WHERE k.doc_id % 4 = 0 AND k.text = d.text)""")
def stateful_ingest(spark, d):
    """Contents of arriving documents, once each, that a quarter of the table, known before, has not: read as a stream whose state holds what was seen."""
    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    docs = R.read(spark, d, "documents").select("doc_id", F.col("text").alias("code"))
    known = docs.filter("doc_id % 4 = 0 and code is not null").select(code_hash(F.col("code")).alias("content_hash"))
    # a table is one file or a folder of them; a stream reads it by a pattern
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{d}/documents.parque[t]").filter("doc_id % 4 <> 0").select(F.col("text").alias("code"))
    incremental.ingest_stream(spark, stream, f"{folder}/rows", f"{folder}/state", known).awaitTermination()
    return incremental.read_ingested(spark, f"{folder}/rows", f"{folder}/state").select("content_hash")


@query("SELECT date_trunc('day', ts)::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_monitor(spark, d):
    w = incremental.windowed_counts(R.read(spark, d, "events"))
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


#: Documents and a mirror that lacks some, has others too, and has changed texts.
MIRROR_SQL = """WITH s AS (SELECT doc_id, sha256(text) AS h, lang FROM documents),
m AS (SELECT doc_id, CASE WHEN doc_id % 31 = 5 THEN sha256(coalesce(text, '') || 'x') ELSE sha256(text) END AS h, CASE WHEN doc_id % 43 = 1 THEN NULL ELSE lang END AS lang FROM documents WHERE doc_id % 50 <> 7
  UNION ALL SELECT doc_id + 1000000000, sha256(text), lang FROM documents WHERE doc_id % 97 = 0)"""


def _mirrored(spark, d):
    docs = R.read(spark, d, "documents").select("doc_id", "text", "lang")
    hashed = lambda df, text: df.select("doc_id", F.sha2(text, 256).alias("h"), "lang")
    changed = docs.filter("doc_id % 50 <> 7").withColumn("lang", F.when(F.col("doc_id") % 43 != 1, F.col("lang"))).withColumn("text", F.when(F.col("doc_id") % 31 == 5, F.concat(F.coalesce("text", F.lit("")), F.lit("x"))).otherwise(F.col("text")))
    more = docs.filter("doc_id % 97 = 0").withColumn("doc_id", F.col("doc_id") + 1000000000)
    return hashed(docs, F.col("text")), hashed(changed.unionByName(more), F.col("text"))


@query(f"""{MIRROR_SQL} SELECT coalesce(s.doc_id, m.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN 'delete' WHEN m.doc_id IS NULL THEN 'insert' ELSE 'update' END AS action
FROM s FULL OUTER JOIN m ON s.doc_id = m.doc_id WHERE s.doc_id IS NULL OR m.doc_id IS NULL OR s.h IS DISTINCT FROM m.h OR s.lang IS DISTINCT FROM m.lang""")
def mirror_sync(spark, d):
    """What a mirror of the documents must delete, insert and update, by digests of key ranges."""
    return mirror.sync_plan(*_mirrored(spark, d), ["doc_id"], ["h", "lang"])


@query(f"""WITH u AS (SELECT unnest(generate_series(0, 100)) AS replicate), {R.PREDICTIONS_SQL},
ids AS (SELECT sample_id, replicate, CASE WHEN replicate = 0 THEN 1 ELSE len(list_filter({intervals.POISSON}, lambda b: ('0x' || substr(md5(sample_id || ':' || ((replicate - 1) // 4)), ((replicate - 1) % 4) * 8 + 1, 8))::BIGINT >= b)) END AS w
  FROM (SELECT DISTINCT sample_id FROM v_predictions), u),
p AS (SELECT tool, variant, replicate, ground_truth, predicted, sum(w)::BIGINT AS w FROM v_predictions JOIN ids USING (sample_id) WHERE w > 0 GROUP BY ALL),
x AS (SELECT *, unnest({R._list(K.TARGETS)}) AS cwe FROM p),
c AS (SELECT tool, variant, replicate, cwe, sum(w * (ground_truth = cwe AND list_contains(predicted, cwe))::INT) AS tp, sum(w * (ground_truth <> cwe AND list_contains(predicted, cwe))::INT) AS fp, sum(w * (ground_truth = cwe AND NOT list_contains(predicted, cwe))::INT) AS fn FROM x GROUP BY ALL),
f AS (SELECT tool, variant, replicate, 'macro_f1' AS metric, avg(2.0 * tp / (2 * tp + fp + fn)) AS v FROM c WHERE tp + fp + fn > 0 GROUP BY ALL),
b AS (SELECT tool, variant, replicate, sum(w * (ground_truth <> 'safe' AND len(predicted) > 0)::INT)::DOUBLE AS tp, sum(w * (ground_truth = 'safe' AND len(predicted) > 0)::INT)::DOUBLE AS fp, sum(w * (ground_truth <> 'safe' AND len(predicted) = 0)::INT)::DOUBLE AS fn, sum(w * (ground_truth = 'safe' AND len(predicted) = 0)::INT)::DOUBLE AS tn FROM p GROUP BY ALL),
m AS (SELECT tool, variant, replicate, 'mcc' AS metric, (tp * tn - fp * fn) / sqrt(nullif((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn), 0)) AS v FROM b),
k AS (SELECT tool, variant, replicate, ground_truth AS a, coalesce(predicted[1], 'safe') AS b, sum(w) AS n FROM p GROUP BY ALL), ka AS (SELECT tool, variant, replicate, a, sum(n) AS na FROM k GROUP BY ALL), kb AS (SELECT tool, variant, replicate, b, sum(n) AS nb FROM k GROUP BY ALL),
o AS (SELECT tool, variant, replicate, sum(({WEIGHT_SQL}) * n) AS o, sum(n) AS n FROM k GROUP BY ALL), e AS (SELECT tool, variant, replicate, sum(({WEIGHT_SQL}) * na * nb) AS e FROM ka JOIN kb USING (tool, variant, replicate) GROUP BY ALL),
q AS (SELECT tool, variant, replicate, 'kappa' AS metric, 1 - o / nullif(e / n, 0) AS v FROM o JOIN e USING (tool, variant, replicate)),
v AS (SELECT tool, variant, metric, max(v) FILTER (WHERE replicate = 0) AS value, list_sort(list(v) FILTER (WHERE replicate > 0 AND v IS NOT NULL)) AS vs FROM (SELECT * FROM f UNION ALL SELECT * FROM m UNION ALL SELECT * FROM q) GROUP BY ALL)
SELECT tool, variant, metric, round(value, 9) AS value, round(vs[greatest(1, ceil(len(vs) * 0.025::DOUBLE)::INT)], 9) AS low, round(vs[greatest(1, ceil(len(vs) * 0.975::DOUBLE)::INT)], 9) AS high FROM v""")
def bootstrap_intervals(spark, d):
    """Intervals of three metrics over 100 Poisson bootstrap replicates of the samples."""
    out = intervals.bootstrap_intervals(R.predictions(spark, d), 100)
    return out.select("tool", "variant", "metric", *(F.round(c, 9).alias(c) for c in ("value", "low", "high")))


@query("""WITH s AS (SELECT l_linestatus, l_quantity * (1 - l_discount) AS score, l_returnflag = 'R' AS hit FROM lineitem), p AS (SELECT l_linestatus, score, count(*) AS n, count(*) FILTER (WHERE hit) AS h FROM s GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS na, sum(h) OVER w AS ha, sum(h) OVER (PARTITION BY l_linestatus) AS t FROM p WINDOW w AS (PARTITION BY l_linestatus ORDER BY score DESC))
SELECT l_linestatus, round(sum(h / nullif(t, 0)::DOUBLE * (ha / na::DOUBLE)), 9) AS pr_auc, sum(h)::BIGINT AS n_positive, sum(n)::BIGINT AS n FROM c GROUP BY l_linestatus""")
def pr_auc(spark, d):
    """Area under the precision-recall curve of returned lines by their net quantity, which many lines share."""
    rows = R.read(spark, d, "lineitem").select("l_linestatus", (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("score"), (F.col("l_returnflag") == "R").alias("hit"))
    out = intervals.average_precision(rows, ["l_linestatus"], "score", "hit")
    return out.select("l_linestatus", F.round("pr_auc", 9).alias("pr_auc"), "n_positive", "n")


BATCH_SQL = """WITH e AS (SELECT 'doc_' || doc_id AS id, (coalesce(length(text), 0) // 4)::BIGINT AS length FROM documents),
g AS (SELECT *, CASE WHEN length <= 4096 THEN least(4096, (pow(2, ceil(log2(greatest(length, 16) / 16.0::DOUBLE))) * 16)::BIGINT) END AS range FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY range ORDER BY sha256('42:' || id), id) - 1 AS r, 4096 // range AS per FROM g),
b AS (SELECT id, length, range, CASE WHEN range IS NOT NULL THEN r // per END AS batch, CASE WHEN range IS NOT NULL THEN r % per END AS slot, per AS per_batch FROM r)"""


def _batches(spark, d):
    docs = R.read(spark, d, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), F.floor(F.coalesce(F.length("text"), F.lit(0)) / 4).alias("length"))
    return batches.token_batches(docs, 4096)


@query(f"{BATCH_SQL} SELECT id, length, range, batch, slot FROM b")
def token_batches(spark, d):
    """Batches of documents of like length, 4096 places each."""
    return _batches(spark, d).select("id", "length", "range", "batch", "slot")


@query(f"{BATCH_SQL} SELECT range, (max(batch) + 1)::BIGINT AS n_batches, count(*) AS n, round(sum(length) / ((max(batch) + 1) * max(per_batch) * range)::DOUBLE, 9) AS fill FROM b WHERE batch IS NOT NULL GROUP BY range")
def batch_fill(spark, d):
    return batches.fill_rates(_batches(spark, d)).withColumn("fill", F.round("fill", 9))


@query()
def resumed_evaluation(spark, d):
    """Records of a detector on two variants of all documents, one of which an earlier run has done: it is not run again."""

    def detector(rows):
        return {i: {"CWE-502"} for i, text in rows if text and "pickle.loads" in text}

    folder = f"{shared_folder(spark)}/predictions-{uuid.uuid4().hex}"
    code = snippets(spark, d).select(F.col("id").alias("sample_id"), F.col("cwe").alias("ground_truth"), "code")
    clean = code.withColumn("variant", F.lit("clean"))
    incremental.resumable_evaluation(clean, detector, "words", "1", folder)
    both = clean.unionByName(code.withColumn("variant", F.lit("string_split")))
    records, plan = incremental.resumable_evaluation(both, detector, "words", "1", folder)
    return records.join(F.broadcast(plan.select("variant", "action")), "variant").select("variant", "sample_id", "ground_truth", F.array_join("predicted", "|").alias("predicted"), "action")


@query()
def evaluate_rules(spark, d):
    """A detector plug-in that finds words in documents, run on batches."""

    def detector(rows):
        return {i: {"CWE-79"} for i, text in rows if text and "license" in text.lower()}

    docs = R.samples(spark, d).select(F.lit("clean").alias("variant"), F.col("id").alias("sample_id"), F.col("cwe").alias("ground_truth"), "code")
    return incremental.evaluate(docs, detector, "1").select("sample_id", "ground_truth", F.array_join("predicted", "|").alias("predicted"))
