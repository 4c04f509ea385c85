"""Queries: evaluation metrics, advisory and answer parsing, plug-in transforms, resumable runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import advisory, metrics
from ..sources import relations as R
from . import fixtures as S
from .registry import query

WITH = "WITH " + R.PREDICTIONS_SQL
BY = metrics.BY
TARGETS = R._list(K.TARGETS)
CELLS_SQL = f"""{WITH}, x AS (SELECT tool, variant, ground_truth, predicted, unnest({TARGETS}) AS cwe FROM v_predictions),
cells AS (SELECT tool, variant, cwe, count(*) FILTER (WHERE ground_truth = cwe AND list_contains(predicted, cwe)) AS tp, count(*) FILTER (WHERE ground_truth <> cwe AND list_contains(predicted, cwe)) AS fp,
count(*) FILTER (WHERE ground_truth = cwe AND NOT list_contains(predicted, cwe)) AS fn, count(*) FILTER (WHERE ground_truth <> cwe AND NOT list_contains(predicted, cwe)) AS tn FROM x GROUP BY tool, variant, cwe),
pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r FROM cells),
scored AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM pr),
macro AS (SELECT tool, variant, coalesce(avg(f1) FILTER (WHERE tp + fn + fp > 0), 0) AS macro_f1 FROM scored GROUP BY tool, variant)"""
BINARY_SQL = f"""{WITH}, b AS (SELECT tool, variant, count(*) FILTER (WHERE ground_truth <> 'safe' AND len(predicted) > 0) AS tp, count(*) FILTER (WHERE ground_truth = 'safe' AND len(predicted) > 0) AS fp,
count(*) FILTER (WHERE ground_truth <> 'safe' AND len(predicted) = 0) AS fn, count(*) FILTER (WHERE ground_truth = 'safe' AND len(predicted) = 0) AS tn FROM v_predictions GROUP BY tool, variant)"""
SIMILAR_SQL = "CASE " + " ".join(f"WHEN a = '{a}' AND b = '{b}' THEN {v!r}::DOUBLE" for (a, b), v in metrics.SIMILARITY.items() if a in K.TARGETS and b in K.TARGETS) + " END"


def _scores(spark, d):
    docs = R.read(spark, d, "documents")
    return docs.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("sample_id"), (F.col("doc_id") % 100 / 10.0).alias("score"))


@query(f"{CELLS_SQL} SELECT tool, variant, cwe, tp, fp, fn, tn FROM cells")
def confusion(spark, d):
    return metrics.confusion(R.predictions(spark, d))


@query(f"{CELLS_SQL} SELECT tool, variant, cwe, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1, tp + fn AS support FROM scored")
def class_scores(spark, d):
    c = metrics.class_scores(metrics.confusion(R.predictions(spark, d)))
    return c.select(*BY, "cwe", *(F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")), "support")


@query(f"{CELLS_SQL} SELECT tool, variant, round(macro_f1, 9) AS macro_f1 FROM macro")
def macro_f1(spark, d):
    return metrics.macro_f1(R.predictions(spark, d)).withColumn("macro_f1", F.round("macro_f1", 9))


@query(f"{BINARY_SQL} SELECT tool, variant, tp, fp, fn, tn, round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt(nullif((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn), 0)), 9) AS mcc FROM b")
def mcc(spark, d):
    return metrics.mcc(R.predictions(spark, d)).withColumn("mcc", F.round("mcc", 9))


@query(f"""{WITH}, s AS (SELECT 'doc_' || doc_id AS sample_id, (doc_id % 100) / 10.0::DOUBLE AS score FROM documents WHERE doc_id % 100 > 0)
SELECT tool, variant, round(coalesce(sum(score) FILTER (WHERE len(predicted) > 0), 0) / sum(score), 9) AS swr, count(score) AS pool, count(*) - count(score) AS excluded FROM v_predictions LEFT JOIN s USING (sample_id) WHERE ground_truth <> 'safe' GROUP BY tool, variant""")
def swr(spark, d):
    return metrics.severity_weighted_recall(R.predictions(spark, d), _scores(spark, d)).withColumn("swr", F.round("swr", 9))


@query(f"""{WITH}, x AS (SELECT tool, variant, sample_id, ground_truth AS b, unnest(CASE WHEN len(predicted) = 0 THEN ['none'] ELSE predicted END) AS a FROM v_predictions WHERE ground_truth <> 'safe'),
s AS (SELECT tool, variant, sample_id, b, max(coalesce({SIMILAR_SQL}, 0)) AS s FROM x GROUP BY ALL), c AS (SELECT tool, variant, b, avg(s) AS s FROM s GROUP BY ALL)
SELECT tool, variant, round(avg(s), 9) AS hcma FROM c GROUP BY tool, variant""")
def hcma(spark, d):
    return metrics.hcma(R.predictions(spark, d)).withColumn("hcma", F.round("hcma", 9))


WEIGHT_SQL = f"CASE WHEN a = b THEN 0 WHEN a = 'safe' OR b = 'safe' THEN 1 ELSE 1 - ({SIMILAR_SQL}) END"


@query(f"""{WITH}, c AS (SELECT tool, variant, ground_truth AS a, coalesce(predicted[1], 'safe') AS b, count(*) AS n FROM v_predictions GROUP BY ALL), r AS (SELECT tool, variant, a, sum(n) AS na FROM c GROUP BY ALL), k AS (SELECT tool, variant, b, sum(n) AS nb FROM c GROUP BY ALL),
o AS (SELECT tool, variant, sum(({WEIGHT_SQL}) * n) AS o, sum(n) FILTER (WHERE a = b) AS same, sum(n) AS n FROM c GROUP BY ALL), e AS (SELECT tool, variant, sum(({WEIGHT_SQL}) * na * nb) AS e FROM r JOIN k USING (tool, variant) GROUP BY ALL)
SELECT tool, variant, round(1 - o / nullif(e / n, 0), 9) AS kappa, round(coalesce(same, 0) / n, 9) AS observed_agreement, n::BIGINT AS n FROM o JOIN e USING (tool, variant)""")
def weighted_kappa(spark, d):
    k = metrics.weighted_kappa(R.predictions(spark, d))
    return k.select(*BY, F.round("kappa", 9).alias("kappa"), F.round("observed_agreement", 9).alias("observed_agreement"), "n")


def _ragged(spark, d):
    """Predictions of which a variant lacks some ids."""
    p = R.predictions(spark, d)
    return p.filter((F.col("variant") == "clean") | (F.substring("sample_id", -1, 1) != "3"))


DROP_SQL = f"""{WITH}, g AS (SELECT * FROM v_predictions WHERE variant = 'clean' OR right(sample_id, 1) <> '3'),
base AS (SELECT c.tool, o.variant, c.ground_truth, c.predicted FROM g c JOIN g o ON c.tool = o.tool AND c.sample_id = o.sample_id AND o.variant <> 'clean' WHERE c.variant = 'clean'),
u AS (SELECT 'base' AS side, * FROM base UNION ALL SELECT 'other', tool, variant, ground_truth, predicted FROM g WHERE variant <> 'clean'),
x AS (SELECT side, tool, variant, ground_truth, predicted, unnest({TARGETS}) AS cwe FROM u),
c AS (SELECT side, tool, variant, cwe, count(*) FILTER (WHERE ground_truth = cwe AND list_contains(predicted, cwe)) AS tp, count(*) FILTER (WHERE ground_truth <> cwe AND list_contains(predicted, cwe)) AS fp, count(*) FILTER (WHERE ground_truth = cwe AND NOT list_contains(predicted, cwe)) AS fn FROM x GROUP BY ALL),
f AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM c),
m AS (SELECT tool, variant, coalesce(avg(f1) FILTER (WHERE side = 'base' AND tp + fp + fn > 0), 0) AS was, coalesce(avg(f1) FILTER (WHERE side = 'other' AND tp + fp + fn > 0), 0) AS now FROM f GROUP BY tool, variant)"""


@query(f"{DROP_SQL} SELECT tool, variant, round(was, 9) AS macro_f1_clean, round(now, 9) AS macro_f1, round(was - now, 9) AS drop FROM m")
def robustness_drop(spark, d):
    r = metrics.robustness_drop(_ragged(spark, d))
    return r.select(*BY, *(F.round(c, 9).alias(c) for c in ("macro_f1_clean", "macro_f1", "drop")))


@query(f"{DROP_SQL} SELECT tool, round(avg(was - now), 9) AS mean_drop FROM m GROUP BY tool")
def mean_single_drop(spark, d):
    return metrics.mean_single_drop(metrics.robustness_drop(_ragged(spark, d))).withColumn("mean_drop", F.round("mean_drop", 9))


@query(f"""{CELLS_SQL}, {BINARY_SQL.split(', b AS', 1)[1].join(['b AS', ''])} SELECT tool, variant, round(macro_f1, 9) AS macro_f1, round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt(nullif((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn), 0)), 9) AS mcc, (tp + fp + fn + tn)::BIGINT AS n FROM macro JOIN b USING (tool, variant)""")
def score_bundle(spark, d):
    s = metrics.score_bundle(R.predictions(spark, d), _scores(spark, d))
    return s.select(*BY, F.round("macro_f1", 9).alias("macro_f1"), F.round("mcc", 9).alias("mcc"), "n")


@query(f"""{WITH}, {R.values_sql('g', 'tool, macro_f1, hcma, kappa, observed_agreement', [('g', 0.5, 0.416667, 0.166667, 0.4)])}, {R.values_sql('k', 'truth, said', [(t, p) for _, _, _, t, p in S.GOLD])}
SELECT tool, macro_f1::DOUBLE AS macro_f1, hcma::DOUBLE AS hcma, kappa::DOUBLE AS kappa, observed_agreement::DOUBLE AS observed_agreement, (SELECT count(*) FROM v_predictions p WHERE EXISTS (SELECT 1 FROM k WHERE truth = p.ground_truth AND array_to_string(said, '|') = array_to_string(p.predicted, '|'))) AS n_alike FROM g""")
def published_scores(spark, d):
    """Records whose scores are published, scored beside all predictions of the table, and how many of these are like one of them."""
    gold, own = S.frame(spark, S.GOLD_DDL, S.GOLD), R.predictions(spark, d)
    alike = own.join(F.broadcast(gold.select("ground_truth", "predicted").distinct()), ["ground_truth", "predicted"], "left_semi").agg(F.count(F.lit(1)).alias("n_alike"))
    s = metrics.score_bundle(gold.unionByName(own), S.frame(spark, "sample_id string, score double", [("a", 5.0)])).filter("tool = 'g'")
    return s.crossJoin(alike).select("tool", *(F.round(c, 6).alias(c) for c in ("macro_f1", "hcma", "kappa", "observed_agreement")), "n_alike")


TREE_VALUES = ", ".join(f"('{c}', '{p}')" for c, p in K.TREE)


@query(f"""WITH RECURSIVE {R.PREDICTIONS_SQL}, said AS (SELECT a, b, count(*) AS n FROM (SELECT ground_truth AS a, unnest(predicted) AS b FROM v_predictions) GROUP BY a, b), edges(child, parent) AS (VALUES {TREE_VALUES}), up AS (SELECT child AS node, child AS ancestor, 0 AS up FROM edges UNION ALL SELECT up.node, e.parent, up.up + 1 FROM up JOIN edges e ON up.ancestor = e.child),
depth AS (SELECT node, max(up) AS depth FROM up GROUP BY node), own AS (SELECT * FROM up WHERE node IN ('22', '78', '79', '89', '94', '502', '918')),
m AS (SELECT a.node AS a, b.node AS b, max(coalesce(d.depth, 0)) AS low FROM own a JOIN own b ON a.ancestor = b.ancestor LEFT JOIN depth d ON d.node = a.ancestor GROUP BY a.node, b.node)
SELECT 'CWE-' || m.a AS a, 'CWE-' || m.b AS b, round(CASE WHEN m.a = m.b THEN 1 ELSE 2.0::DOUBLE * low / (x.depth + y.depth) END, 9) AS similarity, coalesce(n, 0) AS n
FROM m JOIN depth x ON x.node = m.a JOIN depth y ON y.node = m.b LEFT JOIN said ON said.a = 'CWE-' || m.a AND said.b = 'CWE-' || m.b""")
def wu_palmer(spark, d):
    """Similarity of each two classes, and how often the one was predicted where the other was true."""
    said = R.predictions(spark, d).select(F.col("ground_truth").alias("a"), F.explode("predicted").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return metrics.wu_palmer(spark).join(said, ["a", "b"], "left").select("a", "b", F.round("similarity", 9).alias("similarity"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""{BINARY_SQL}, r AS (SELECT tool, variant, tp::DOUBLE AS k, (tp + fn)::DOUBLE AS n FROM b)
SELECT tool, variant, round((k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 8) AS low,
round((k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 8) AS high FROM r""")
def recall_interval(spark, d):
    b = metrics.binary(R.predictions(spark, d))
    low, high = metrics.wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    return b.select(*BY, F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


@query("""WITH p AS (SELECT o_orderkey % 5 AS part, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS y, o_totalprice * 0.9::DOUBLE AS p FROM orders)
SELECT part, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, count(y) AS n FROM p GROUP BY part""")
def mae_rmse(spark, d):
    o = R.read(spark, d, "orders").select((F.col("o_orderkey") % 5).alias("part"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("y"), (F.col("o_totalprice") * 0.9).alias("p"))
    r = metrics.regression_errors(o, "p", "y", ["part"])
    return r.select("part", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), "n")


@query("""WITH p AS (SELECT label AS y, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS yhat FROM embeddings), l AS (SELECT y, yhat, unnest(list_distinct([y, yhat])) AS label FROM p),
c AS (SELECT label, count(*) FILTER (WHERE y = label AND yhat = label) AS tp, count(*) FILTER (WHERE y <> label AND yhat = label) AS fp, count(*) FILTER (WHERE y = label AND yhat <> label) AS fn FROM l GROUP BY label)
SELECT label::BIGINT AS label, tp, fp, fn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 9) AS f1 FROM c""")
def argmax_scores(spark, d):
    v = F.slice("embedding", 1, 10)
    e = R.read(spark, d, "embeddings").select(F.col("label").cast("long").alias("y"), (F.array_position(v, F.array_max(v)) - 1).alias("yhat"))
    return metrics.argmax_scores(e, []).withColumn("f1", F.round("f1", 9))


@query("""WITH h AS (SELECT vec_id, unnest(['h0', 'h1', 'h2']) AS head, unnest([label % 3, label % 4, CASE WHEN label % 2 = 0 THEN label END]) AS y, unnest([vec_id % 3, vec_id % 4, label]) AS yhat FROM embeddings)
SELECT head, count(y) AS n, round(avg((y = yhat)::INT), 9) AS accuracy FROM h WHERE y IS NOT NULL GROUP BY head""")
def head_accuracy(spark, d):
    e = R.read(spark, d, "embeddings")
    y, v = F.col("label"), F.col("vec_id")
    heads = F.array(*(F.struct(F.lit(h).alias("head"), a.cast("long").alias("y"), b.cast("long").alias("yhat")) for h, a, b in (("h0", y % 3, v % 3), ("h1", y % 4, v % 4), ("h2", F.when(y % 2 == 0, y), y))))
    rows = e.select(F.explode(heads).alias("x")).select("x.*").filter("y is not null")
    return rows.groupBy("head").agg(F.count("y").alias("n"), F.round(F.avg((F.col("y") == F.col("yhat")).cast("int")), 9).alias("accuracy"))


@query("""WITH e AS (SELECT vec_id, vec_id // 16 AS batch, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT a.batch, count(*) AS n_pairs, round(avg(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))), 6) AS mean_dot FROM e a JOIN e b ON a.batch = b.batch AND a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.batch""")
def supcon_pairs(spark, d):
    e = R.read(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 16).cast("long").alias("batch"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    o = e.select("batch", "label", F.col("vec_id").alias("other"), F.col("v").alias("w"))
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return e.join(o, ["batch", "label"]).filter("vec_id <> other").groupBy("batch").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg(dot), 6).alias("mean_dot"))


# parsing


@query("""SELECT lang, count(*) AS calls, sum(100 + length(text) // 4)::BIGINT AS tokens_in, round(sum(100 + length(text) // 4) / 1e6 * 3.0 + count(*) * 60 / 1e6 * 15.0, 4) AS cost FROM documents GROUP BY ROLLUP(lang)""")
def cost_projection(spark, d):
    n = (F.floor(F.length("text") / 4) + 100).cast("long")
    docs = R.read(spark, d, "documents").select("lang", n.alias("n"))
    return docs.rollup("lang").agg(F.count(F.lit(1)).alias("calls"), F.sum("n").alias("tokens_in"), F.round(advisory.cost(F.sum("n"), F.count(F.lit(1)) * 60, 3.0, 15.0), 4).alias("cost"))


@query("""WITH m AS (SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id) SELECT roles, count(*) AS n FROM m GROUP BY roles ORDER BY n DESC, roles LIMIT 10""")
def top_reasons(spark, d):
    c = R.read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x.role), ",").alias("roles"))
    return c.groupBy("roles").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "roles").limit(10)
