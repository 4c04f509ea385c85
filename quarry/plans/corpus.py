"""Queries: deduplication, text signals, gates, purging, severity, splits, weights, table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import severity as V
from ..functions import text as X
from ..operators import advisory, curate, split, weights
from ..sources import relations as R
from . import fixtures as S
from .registry import query

WITH = "WITH " + R.SAMPLES_SQL


# deduplication and text scalars


@query(f"""{WITH}, h AS (SELECT id, doc_id, cwe, substr(sha256(code), 1, 16) AS content_hash FROM v_samples)
SELECT id, cwe, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) = 1 AS kept FROM h""")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return curate.dedup_by_hash(R.samples(spark, d)).select("id", "cwe", "content_hash", "kept")


@query(f"""{WITH}, h AS (SELECT cwe, row_number() OVER (PARTITION BY sha256(code) ORDER BY doc_id) = 1 AS kept FROM v_samples)
SELECT cwe, count(*) FILTER (WHERE kept) AS n_kept, count(*) FILTER (WHERE NOT kept) AS n_removed FROM h GROUP BY cwe""")
def dedup_stats(spark, d):
    return curate.dedup_by_hash(R.samples(spark, d)).groupBy("cwe").agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_removed"))


@query("""SELECT doc_id, regexp_matches(text, '(?i)copyright|license|all rights reserved') AS has_license, regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') AS has_mail,
contains(text, '|') AS has_pipe, length(text) // 4 AS est_tokens, upper(regexp_extract(text, '(?i)CVE-[0-9]{4}-[0-9]{4,7}', 0)) <> '' AS has_cve FROM documents""")
def text_signals(spark, d):
    t = F.col("text")
    docs = R.read(spark, d, "documents")
    return docs.select("doc_id", t.rlike("(?i)copyright|license|all rights reserved").alias("has_license"), t.rlike(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+").alias("has_mail"), t.contains("|").alias("has_pipe"), F.floor(F.length(t) / 4).cast("long").alias("est_tokens"), X.extract_cve(t).isNotNull().alias("has_cve"))


@query(r"""WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS ls FROM documents)
SELECT doc_id, len(list_filter(ls, lambda x: trim(x) <> '')) AS n_nonblank, len(list_filter(ls, lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#'))) AS n_code, len(list_filter(ls, lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#'))) >= 5 AS enough FROM l""")
def line_counts(spark, d):
    t = F.col("text")
    return R.read(spark, d, "documents").select("doc_id", X.nonblank_lines(t).cast("long").alias("n_nonblank"), X.code_lines(t).cast("long").alias("n_code"), (X.code_lines(t) >= 5).alias("enough"))


@query(r"""WITH u AS (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS t FROM documents)
SELECT doc_id, sha256(regexp_replace(regexp_replace(t, '[ \t]+(\n|$)', '\1', 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g')) AS normal_sha FROM u""")
def normalize_text(spark, d):
    return R.read(spark, d, "documents").select("doc_id", F.sha2(X.normalize(F.col("text")), 256).alias("normal_sha"))


# gates and audits



@query(f"""{WITH} SELECT id, source, cwe FROM v_samples s WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('src1', 'CWE-78'), ('src2', 'CWE-22'), ('src3', 'CWE-94')) b(source, cwe) WHERE b.source = s.source AND b.cwe = s.cwe)""")
def blocked_antijoin(spark, d):
    blocked = S.frame(spark, "source string, cwe string", [("src1", "CWE-78"), ("src2", "CWE-22"), ("src3", "CWE-94")])
    return R.samples(spark, d, False).join(F.broadcast(blocked), ["source", "cwe"], "left_anti").select("id", "source", "cwe")


# severity


@query(f"WITH {R.CVSS_SQL} SELECT id, " + ", ".join(f"CASE WHEN cvss_vector IS NULL THEN NULL ELSE nullif(regexp_extract(cvss_vector, '(^|/){k}:([A-Z])', 2), '') END AS {k.lower()}" for k in V.KEYS) + ", cvss_vector IS NOT NULL AND length(cvss_vector) > 30 AS whole FROM v_cvss")
def cvss_parse(spark, d):
    p = V.parts(F.col("cvss_vector"))
    return R.cvss_rows(spark, d).select("id", *(v.alias(k.lower()) for k, v in p.items()), V.is_whole(F.col("cvss_vector")).alias("whole"))


GRID = {k: list(v) for k, v in K.CVSS_LETTERS.items()}
_w = lambda m, t: f"CASE {m} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in t.items()) + " ELSE 0 END"


def _score_sql(names: dict[str, str]) -> str:
    """The base score of metric letters in SQL."""
    w = {k: _w(names[k], t) for k, t in K.CVSS_WEIGHTS.items()}
    changed = f"{names['S']} = 'C'"
    pr = f"CASE WHEN {changed} THEN {_w(names['PR'], K.CVSS_PRIVILEGES['C'])} ELSE {_w(names['PR'], K.CVSS_PRIVILEGES['U'])} END"
    iss = f"(1 - (1 - ({w['C']})) * (1 - ({w['I']})) * (1 - ({w['A']})))"
    impact = f"(CASE WHEN {changed} THEN 7.52::DOUBLE * ({iss} - 0.029::DOUBLE) - 3.25::DOUBLE * pow({iss} - 0.02::DOUBLE, 15::DOUBLE) ELSE 6.42::DOUBLE * {iss} END)"
    reach = f"(8.22::DOUBLE * ({w['AV']}) * ({w['AC']}) * ({pr}) * ({w['UI']}))"
    raw = f"least(CASE WHEN {changed} THEN 1.08::DOUBLE * ({impact} + {reach}) ELSE {impact} + {reach} END, 10::DOUBLE)"
    return f"CASE WHEN {impact} <= 0 THEN 0::DOUBLE ELSE ceil({raw} * 10) / 10::DOUBLE END"


PARTS_SQL = {k: f"regexp_extract(cvss_vector, '(^|/){k}:([A-Z])', 2)" for k in V.KEYS}


@query(f"WITH {R.CVSS_SQL}, o AS (SELECT " + " || ".join(PARTS_SQL[k] for k in GRID) + " AS letters, count(*) AS n FROM v_cvss WHERE cvss_vector IS NOT NULL GROUP BY 1), " + ", ".join(f"t{k}(m{k}) AS (VALUES {', '.join(f'(\'{x}\')' for x in v)})" for k, v in GRID.items()) + " SELECT " + " || ".join(f"m{k}" for k in GRID) + f" AS letters, {_score_sql({k: 'm' + k for k in GRID})} AS score, coalesce(o.n, 0) AS n FROM " + ", ".join(f"t{k}" for k in GRID) + " LEFT JOIN o ON o.letters = " + " || ".join(f"m{k}" for k in GRID))
def cvss_score_all(spark, d):
    """The score of every combination of letters, and how many vectors have it."""
    part = lambda k: F.regexp_extract("cvss_vector", f"(^|/){k}:([A-Z])", 2)
    seen = R.cvss_rows(spark, d).filter("cvss_vector is not null").groupBy(F.concat(*map(part, GRID)).alias("letters")).agg(F.count(F.lit(1)).alias("n"))
    df = spark.range(1)
    for k, v in GRID.items():
        df = df.withColumn(f"m{k}", F.explode(F.array(*map(F.lit, v))))
    letters = {k: F.col(f"m{k}") for k in GRID}
    scored = df.select(F.concat(*letters.values()).alias("letters"), V.base_score(letters).alias("score"))
    return scored.join(seen, "letters", "left").select("letters", "score", F.coalesce("n", F.lit(0)).alias("n"))


TARGET_SQL = f"""{R.CVSS_SQL}, p AS (SELECT *, coalesce(length(cvss_vector) > 30, false) AS whole, {", ".join(f"{s} AS m{k}" for k, s in PARTS_SQL.items())},
  CASE upper(cvss_severity) WHEN 'CRITICAL' THEN 9.5 WHEN 'HIGH' THEN 7.5 WHEN 'MEDIUM' THEN 5.0 WHEN 'LOW' THEN 2.5 WHEN 'NONE' THEN 0.0 END AS mid FROM v_cvss),
q AS (SELECT *, CASE WHEN whole AND cvss_score IS NOT NULL THEN 'advisory' WHEN whole THEN 'computed_from_vector' WHEN cvss_score IS NOT NULL THEN 'advisory_score_only' WHEN mid IS NOT NULL THEN 'band_midpoint' ELSE 'missing' END AS score_source,
  coalesce(cvss_score, CASE WHEN whole THEN {_score_sql({k: 'm' + k for k in V.KEYS})} END, mid::DOUBLE) AS score FROM p),
r AS (SELECT id, score::DOUBLE AS score, score_source, CASE WHEN score_source = 'missing' THEN 'low' WHEN score_source = 'band_midpoint' AND label_confidence = 'high' THEN 'medium' ELSE label_confidence END AS confidence FROM q),
targets AS (SELECT id, score, score_source, confidence, CASE WHEN score_source = 'missing' THEN 0.0 ELSE CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.3 ELSE 0.1 END END::DOUBLE AS loss_weight FROM r)"""


def _targets(spark, d):
    rows, letters = V.with_parts(R.cvss_rows(spark, d), "cvss_vector")
    t = V.target(F.col("cvss_vector"), F.col("cvss_score"), F.col("cvss_severity"), F.col("label_confidence"), letters)
    return rows.select("id", *(c.alias(k) for k, c in t.items()))


@query(f"WITH {TARGET_SQL} SELECT * FROM targets")
def cvss_targets(spark, d):
    return _targets(spark, d)


@query(f"""WITH {TARGET_SQL} SELECT score_source, confidence, count(*) AS n, count(score) AS with_score, round(avg(loss_weight), 6) AS mean_weight FROM targets GROUP BY GROUPING SETS ((score_source), (confidence), ())""")
def cvss_summary(spark, d):
    sets = _targets(spark, d).groupingSets([["score_source"], ["confidence"], []], "score_source", "confidence")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("with_score"), F.round(F.avg("loss_weight"), 6).alias("mean_weight"))


@query(f"WITH {TARGET_SQL} SELECT id, CASE WHEN score >= 9 THEN 'CRITICAL' WHEN score >= 7 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM' WHEN score IS NOT NULL THEN 'LOW' END AS band FROM targets")
def severity_band(spark, d):
    return _targets(spark, d).select("id", V.band(F.col("score")).alias("band"))


@query(f"""WITH {R.CVSS_SQL}, {R.values_sql('v', 'vector, score, lenient', S.VECTORS)} SELECT vector, score::DOUBLE AS score, lenient::DOUBLE AS lenient, (SELECT count(*) FROM v_cvss o WHERE o.cvss_vector IS NOT DISTINCT FROM v.vector) AS n FROM v""")
def cvss_cases(spark, d):
    """Published scores of some vectors, and how many of the table's are the same."""
    seen = R.cvss_rows(spark, d).groupBy(F.col("cvss_vector").alias("seen")).agg(F.count(F.lit(1)).alias("n"))
    rows = S.frame(spark, "vector string, score double, lenient double", S.VECTORS).join(seen, F.col("vector").eqNullSafe(F.col("seen")), "left")
    return rows.select("vector", V.vector_score(F.col("vector")).alias("score"), V.lenient_score(F.col("vector")).alias("lenient"), F.coalesce("n", F.lit(0)).alias("n"))


# caps and splits


@query(f"""{WITH} SELECT id, cwe, cve_id, cve_id IS NULL OR row_number() OVER (PARTITION BY cwe, cve_id ORDER BY id) <= 2 AS kept FROM v_samples""")
def cap_topn(spark, d):
    return split.cap_per_group(R.samples(spark, d, False), ["cwe", "cve_id"], 2, ["id"]).select("id", "cwe", "cve_id", "kept")


@query("""WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem)
SELECT l_orderkey, count(*) FILTER (WHERE r <= 2) AS kept, count(*) FILTER (WHERE r > 2) AS dropped FROM r GROUP BY l_orderkey HAVING count(*) > 2""")
def cap_report(spark, d):
    rows = R.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    capped = split.cap_per_group(rows, ["l_orderkey"], 2, ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    return capped.groupBy("l_orderkey").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped")).filter("dropped > 0")


ORDERED_SQL = "SELECT *, row_number() OVER (PARTITION BY cwe ORDER BY sha256('42:' || id), id) - 1 AS r, count(*) OVER (PARTITION BY cwe) AS n FROM v_samples"
SPLIT_SQL = f"""{WITH}, o AS ({ORDERED_SQL}), p AS (SELECT *, greatest(round_even(n * 0.15::DOUBLE, 0), 1) AS nv, greatest(round_even(n * 0.7::DOUBLE, 0), 1) AS nt FROM o),
s AS (SELECT id, cwe, framework, repo, CASE WHEN n < 10 THEN CASE WHEN r = 0 AND n >= 3 THEN 'test' WHEN r = 1 AND n >= 2 THEN 'val' ELSE 'train' END
  ELSE CASE WHEN r < least(nt, n - nv - greatest(n - nt - nv, 1)) THEN 'train' WHEN r < least(nt, n - nv - greatest(n - nt - nv, 1)) + nv THEN 'val' ELSE 'test' END END AS split FROM p)"""


@query(f"{SPLIT_SQL} SELECT id, cwe, split FROM s")
def stratified_split(spark, d):
    return split.stratified_split(R.samples(spark, d, False))


@query(f"""{WITH}, o AS ({ORDERED_SQL}), p AS (SELECT *, greatest(round_even(n * 0.15::DOUBLE, 0), 1) AS k FROM o)
SELECT id, cwe, CASE WHEN n - 2 * k < 1 OR r < n - 2 * k THEN 'train' WHEN r < n - k THEN 'val' ELSE 'test' END AS split FROM p""")
def legacy_split(spark, d):
    return split.simple_split(R.samples(spark, d, False))


@query(f"{SPLIT_SQL} SELECT framework, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test FROM s GROUP BY framework")
def split_crosstab(spark, d):
    rows = R.samples(spark, d, False)
    return split.cross_tab(split.stratified_split(rows).drop("cwe").join(rows, "id"), "framework")


GROUPS_SQL = f"""{WITH}, own AS (SELECT *, CASE WHEN repo IS NOT NULL AND repo <> '' THEN 'repo::' || repo ELSE 'solo::' || id END AS own_key FROM v_samples),
grouped AS (SELECT o.*, coalesce(p.own_key, o.own_key) AS group_key FROM own o LEFT JOIN own p ON o.parent_sample_id = p.id)"""


@query(f"{GROUPS_SQL} SELECT id, group_key FROM grouped")
def parent_group_key(spark, d):
    return split.group_keys(R.samples(spark, d, False)).select("id", "group_key")


CHAINS_SQL = f"""WITH RECURSIVE {R.CHAINED_SQL}, o AS (SELECT *, CASE WHEN repo IS NOT NULL THEN 'repo::' || repo ELSE 'solo::' || id END AS own FROM v_chained),
l AS (SELECT a.id, b.id AS parent FROM o a JOIN o b ON a.is_hard_negative AND a.parent_sample_id = b.id), r(id, up) AS (SELECT id, id FROM o UNION SELECT r.id, l.parent FROM r JOIN l ON l.id = r.up),
e AS (SELECT r.id, r.up FROM r WHERE r.up NOT IN (SELECT id FROM l)), chained AS (SELECT o.id, o.cwe, coalesce(p.own, o.own) AS group_key FROM o LEFT JOIN e ON e.id = o.id LEFT JOIN o p ON p.id = e.up)"""


@query(f"{CHAINS_SQL} SELECT id, group_key FROM chained")
def parent_chains(spark, d):
    """Group keys that hard negatives inherit up chains of parents."""
    return split.group_keys(R.chained_samples(spark, d)).select("id", "group_key")


@query(f"{CHAINS_SQL} SELECT group_key, count(*) AS n, count(DISTINCT cwe) AS n_classes FROM chained GROUP BY group_key HAVING count(*) > 1")
def chained_groups(spark, d):
    """Sizes of the groups that chains of parents bring together."""
    groups = split.group_keys(R.chained_samples(spark, d)).groupBy("group_key")
    return groups.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cwe").alias("n_classes")).filter("n > 1")


@query(f"""{GROUPS_SQL}, c AS (SELECT group_key, cwe, count(*) AS n FROM grouped GROUP BY group_key, cwe), r AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY n DESC, cwe) AS k FROM c)
SELECT group_key, cwe, n FROM r WHERE k = 1""")
def dominant_label(spark, d):
    return split.dominant_label(split.group_keys(R.samples(spark, d, False)))


@query(f"""{GROUPS_SQL}, c AS (SELECT group_key, count(*) AS n FROM grouped GROUP BY group_key) SELECT count(*) AS n_groups, count(*) FILTER (WHERE n = 1) AS n_single, max(n) AS max_size FROM c""")
def group_stats(spark, d):
    sizes = split.group_keys(R.samples(spark, d, False)).groupBy("group_key").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n") == 1).alias("n_single"), F.max("n").alias("max_size"))


@query(f"""{SPLIT_SQL}, k AS (SELECT coalesce(repo, id) AS g, max((split = 'train')::INT) AS a, max((split = 'val')::INT) AS b, max((split = 'test')::INT) AS c FROM s GROUP BY 1)
SELECT 'train' AS left_split, 'val' AS right_split, count(*) FILTER (WHERE a + b = 2) AS overlap FROM k UNION ALL SELECT 'train', 'test', count(*) FILTER (WHERE a + c = 2) FROM k UNION ALL SELECT 'val', 'test', count(*) FILTER (WHERE b + c = 2) FROM k""")
def leakage_check(spark, d):
    rows = R.samples(spark, d, False)
    placed = split.stratified_split(rows).drop("cwe").join(rows.select("id", F.coalesce("repo", "id").alias("group_key")), "id")
    return split.leakage(placed)


@query(f"""{WITH}, c AS (SELECT cwe, count(*) AS n FROM v_samples GROUP BY cwe) SELECT cwe, n, round_even(n * 0.7::DOUBLE, 0)::BIGINT AS train, round_even(n * 0.15::DOUBLE, 0)::BIGINT AS val,
(n - round_even(n * 0.7::DOUBLE, 0) - round_even(n * 0.15::DOUBLE, 0))::BIGINT AS test FROM c""")
def split_targets(spark, d):
    return split.split_targets(R.samples(spark, d, False))


@query()
def group_split(spark, d):
    """Whole groups by greedy deficits: each choice depends on those before, which SQL cannot state; tests hold its invariants."""
    return split.greedy_group_split(R.samples(spark, d, False))


@query(f"""{WITH}, o AS (SELECT id, cwe, row_number() OVER (PARTITION BY cwe ORDER BY sha256('1:' || id), id) AS r, count(*) OVER (PARTITION BY cwe) AS n FROM v_samples)
SELECT id, cwe FROM o WHERE n <= 30 OR r <= 5""")
def audit_sample(spark, d):
    return split.sample_per_class(R.samples(spark, d, False), 5).select("id", "cwe")


# weights and training tables

RAW_SQL = f"{WITH}, c AS (SELECT cwe, count(*) AS n FROM v_samples GROUP BY cwe)"


@query(f"""{RAW_SQL}, w AS (SELECT cwe, n, (1 - 0.999::DOUBLE) / (1 - pow(0.999::DOUBLE, n)) AS raw FROM c) SELECT cwe, n, round(raw * count(*) OVER () / sum(raw) OVER (), 9) AS weight FROM w""")
def effective_number(spark, d):
    return weights.effective_number(weights.class_counts(R.samples(spark, d, False))).withColumn("weight", F.round("weight", 9))


@query(f"""{RAW_SQL}, w AS (SELECT cwe, n, 1 / pow(n::DOUBLE, 0.25::DOUBLE) AS raw FROM c) SELECT cwe, n, round(raw * 0.5::DOUBLE / max(raw) OVER (), 9) AS margin FROM w""")
def ldam_margins(spark, d):
    return weights.ldam_margins(weights.class_counts(R.samples(spark, d, False))).withColumn("margin", F.round("margin", 9))


MULT_SQL = "CASE cwe " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.MULTIPLIERS.items()) + " ELSE 1.0 END::DOUBLE"


@query(f"{WITH} SELECT id, cwe, {MULT_SQL} AS weight FROM v_samples")
def sample_weights(spark, d):
    return R.samples(spark, d, False).select("id", "cwe", weights.multiplier(F.col("cwe")).alias("weight"))


@query(f"{WITH}, m AS (SELECT id, cwe, {MULT_SQL}::INT AS k FROM v_samples) SELECT id, cwe, unnest(generate_series(1, k))::INT AS copy_index FROM m")
def oversample_index(spark, d):
    return weights.oversample(R.samples(spark, d, False)).select("id", "cwe", "copy_index")


@query(f"{WITH} SELECT id, coalesce(list_position(['{"', '".join(K.LABELS)}'], cwe) - 1, 7)::INT AS class_index, is_hard_negative FROM v_samples")
def feature_table(spark, d):
    return weights.feature_rows(R.samples(spark, d, False)).select("id", "class_index", "is_hard_negative")


# joins, maintenance, set operations


@query("""SELECT n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_returnflag IN ('A', 'R') AND o_orderpriority LIKE '1%' AND l_discount IS NOT NULL GROUP BY n_name""")
def four_way_join(spark, d):
    r = lambda n: R.read(spark, d, n)
    lines = r("lineitem").filter(F.col("l_returnflag").isin("A", "R") & F.col("l_discount").isNotNull())
    joined = lines.join(r("orders").filter(F.col("o_orderpriority").like("1%")), F.col("l_orderkey") == F.col("o_orderkey")).join(r("customer"), F.col("o_custkey") == F.col("c_custkey")).join(r("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))


@query(f"""{WITH}, a AS (SELECT id, cwe, 0 AS batch FROM v_samples WHERE doc_id % 3 <> 0 UNION ALL SELECT id, 'CWE-new' AS cwe, 1 AS batch FROM v_samples WHERE doc_id % 4 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch DESC) AS k FROM a) SELECT id, cwe, batch FROM r WHERE k = 1""")
def upsert_latest(spark, d):
    s = R.samples(spark, d, False)
    old = s.filter("doc_id % 3 <> 0").select("id", "cwe", F.lit(0).alias("batch"))
    new = s.filter("doc_id % 4 = 0").select("id", F.lit("CWE-new").alias("cwe"), F.lit(1).alias("batch"))
    return curate.latest_per_key(old, new, "id", "batch")


def _assigned(spark, d):
    s = R.samples(spark, d, False).select("id", "doc_id", F.when(F.col("doc_id") % 3 == 0, "train").alias("split"))
    return s, s.filter("doc_id % 2 = 0").select("id", F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train").alias("split"))


ASSIGN_SQL = f"{WITH}, o AS (SELECT id, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'train' END AS split, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END END AS new FROM v_samples)"


@query(f"{ASSIGN_SQL} SELECT id, new AS split, new IS DISTINCT FROM split AS changed FROM o")
def update_or_clear(spark, d):
    rows, new = _assigned(spark, d)
    return curate.apply_assignment(rows, new, "id", "split", True).select("id", "split", "changed")


@query(f"{ASSIGN_SQL} SELECT id, coalesce(new, split) AS split, coalesce(new, split) IS DISTINCT FROM split AS changed FROM o")
def bulk_update(spark, d):
    rows, new = _assigned(spark, d)
    return curate.apply_assignment(rows, new, "id", "split", False).select("id", "split", "changed")


@query(f"{WITH}, s AS (SELECT id FROM v_samples WHERE doc_id % 3 <> 0), m AS (SELECT id FROM v_samples WHERE doc_id % 5 <> 0) SELECT coalesce(s.id, m.id) AS id, CASE WHEN s.id IS NULL THEN 'delete' WHEN m.id IS NULL THEN 'insert' ELSE 'keep' END AS action FROM s FULL JOIN m ON s.id = m.id")
def mirror_diff(spark, d):
    s = R.samples(spark, d, False)
    return curate.mirror_plan(s.filter("doc_id % 3 <> 0"), s.filter("doc_id % 5 <> 0"), "id")


@query(f"{WITH} SELECT id FROM v_samples WHERE repo IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT repo FROM v_samples WHERE doc_id % 10 = 1) x WHERE x.repo = v_samples.repo)")
def skipset_anti(spark, d):
    s = R.samples(spark, d, False).filter("repo is not null")
    return s.join(s.filter("doc_id % 10 = 1").select("repo").distinct(), "repo", "left_anti").select("id")


@query(f"{WITH} SELECT id, CASE WHEN cwe = 'CWE-79' THEN 'CWE-78' ELSE cwe END AS cwe, CASE WHEN cwe = 'CWE-79' THEN 'merged' END AS note FROM v_samples")
def relabel(spark, d):
    s = R.samples(spark, d, False).withColumn("provenance_notes", F.array().cast("array<string>"))
    return curate.relabel(s, "CWE-79", "CWE-78", "merged").select("id", "cwe", F.try_element_at("provenance_notes", F.lit(-1)).alias("note"))


@query(f"{WITH} SELECT id, 'clean' AS variant FROM v_samples WHERE cwe <> 'safe' AND doc_id % 7 = 1 UNION ALL SELECT id, 'safe' FROM v_samples WHERE (cwe = 'safe' OR is_hard_negative) AND id NOT IN ('doc_7', 'doc_15', 'doc_23')")
def safe_union(spark, d):
    s = R.samples(spark, d, False)
    positive = s.filter("cwe <> 'safe' and doc_id % 7 = 1").select("id", F.lit("clean").alias("variant"))
    safe = s.filter((F.col("cwe") == "safe") | F.col("is_hard_negative")).filter(~F.col("id").isin("doc_7", "doc_15", "doc_23"))
    return curate.union_sources(positive, safe.select("id", F.lit("safe").alias("variant")))


@query(f"{WITH} SELECT id, v.variant FROM v_samples, (SELECT unnest({R._list(K.VARIANTS)}) AS variant) v WHERE cwe <> 'safe' AND NOT is_hard_negative")
def variant_grid(spark, d):
    s = R.samples(spark, d, False).filter("cwe <> 'safe' and not is_hard_negative")
    return s.select("id", F.explode(F.array(*map(F.lit, K.VARIANTS))).alias("variant"))


@query(f"{WITH} SELECT source, count(*) AS n FROM v_samples WHERE starts_with(source, 'src1') GROUP BY source")
def rollback_manifest(spark, d):
    return curate.rollback(R.samples(spark, d, False), "src1")[1].groupBy("source").agg(F.sum("n").alias("n"))


@query(f"{WITH} SELECT id, cwe, row_number() OVER (PARTITION BY cwe, framework ORDER BY id) AS folder_index FROM v_samples WHERE cwe <> 'safe'")
def export_index(spark, d):
    s = R.samples(spark, d, False).filter("cwe <> 'safe'").select("id", "cwe", F.struct("cwe", "framework").alias("folder"))
    return split.ordered_rank(s, "folder", "id").select("id", "cwe", F.col("r").alias("folder_index"))


# lines and differences


@query(r"""WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS ls FROM documents), n AS (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) AS line FROM l)
SELECT doc_id, line::INT AS line, sha256(trim(t)) AS line_sha FROM n WHERE regexp_matches(t, '(?i)license|copyright|rights reserved')""")
def sink_lines(spark, d):
    found = X.sink_lines(F.col("text"), ["(?i)license|copyright|rights reserved"])
    return R.read(spark, d, "documents").select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.line", F.sha2("x.text", 256).alias("line_sha"))


@query(r"""WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS ls FROM documents), n AS (SELECT doc_id AS id, generate_subscripts(ls, 1)::INT AS line, regexp_matches(unnest(ls), '(?i)license|copyright') AS flag FROM l)
SELECT id, line, max(flag::INT) OVER (PARTITION BY id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS near FROM n""")
def proximity_window(spark, d):
    flagged = F.transform(X.lines(F.col("text")), lambda t: t.rlike("(?i)license|copyright"))
    rows = R.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode(flagged).alias("p", "flag"))
    return advisory.proximity(rows.select("id", (F.col("p") + 1).alias("line"), "flag"), 2).select("id", "line", "near")
