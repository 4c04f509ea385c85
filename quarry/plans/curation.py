"""Queries: gates, cleaning, refiltering, purging, audits and exports over code rows derived from the documents, with SQL that judges the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import syntax
from ..functions import text as X
from ..operators import curate, detectors, split, stages
from ..operators.lineage import shared_folder
from ..sources import snippets as C
from ..sources.relations import literal
from .registry import query

WITH = "WITH " + C.SNIPPETS_SQL
AHEAD = r"(?!.*safe_load)"


def found(text: str, patterns: list[str]) -> str:
    """SQL: whether one of the patterns is found. A look-ahead, which the engine lacks, is written as a second condition."""
    one = lambda p: f"regexp_matches({text}, {literal(p)})"
    parts = [f"({one(p.replace(AHEAD, ''))} AND NOT {one(p.replace(AHEAD, '.*safe_load'))})" if AHEAD in p else one(p) for p in patterns]
    return "(" + " OR ".join(parts) + ")"


def by_class(cases: dict[str, str], otherwise: str) -> str:
    return "CASE cwe " + " ".join(f"WHEN '{c}' THEN {x}" for c, x in cases.items()) + f" ELSE {otherwise} END"


def code_rows(spark: SparkSession, d: str) -> DataFrame:
    return C.snippets(spark, d)


# text that does not count, and lines


NO_STRINGS = r"regexp_replace(regexp_replace(code, '(?s)\"\"\".*?\"\"\"', '', 'g'), '(?s)'''.*?'''', '', 'g')".replace("'''", "''''''")
NO_COMMENTS = rf"regexp_replace({NO_STRINGS}, '#[^\n]*', '', 'g')"


@query(rf"""{WITH} SELECT id, sha256(regexp_replace({NO_COMMENTS}, '\s+', '', 'g')) AS bare_sha, len(regexp_split_to_array(code, '\n')) AS n_lines, length(code) AS n FROM v_snippets""")
def comment_strip(spark, d):
    """What is left of code without comments and triple-quoted strings, white space aside; lines and length stay."""
    bare = F.col("bare")
    rows = code_rows(spark, d).select("id", syntax.strip_comments_udf("code").alias("bare"))
    return rows.select("id", F.sha2(F.regexp_replace(bare, r"\s+", ""), 256).alias("bare_sha"), F.size(F.split(bare, "\n")).cast("long").alias("n_lines"), F.length(bare).cast("long").alias("n"))


@query(f"{WITH} SELECT id, shape <> {C.BROKEN} AS valid FROM v_snippets")
def valid_syntax(spark, d):
    """Whether the parser takes each program; by construction all but one kind are valid."""
    return code_rows(spark, d).select("id", syntax.is_valid_python("code").alias("valid"))


@query(rf"""{WITH}, b AS (SELECT *, regexp_extract(path, '[^/]+$') AS base FROM v_snippets)
SELECT id, regexp_matches(path, {literal(K.TEST_PATH)}) OR starts_with(base, 'test_') OR ends_with(base, '_test.py') OR base = 'conftest.py' AS is_test FROM b""")
def path_is_test(spark, d):
    return code_rows(spark, d).select("id", X.is_test_path(F.col("path")).alias("is_test"))


@query(rf"{WITH} SELECT id, upper(nullif(regexp_extract(code, '(?i)CVE-[0-9]{{4}}-[0-9]{{4,7}}'), '')) AS cve FROM v_snippets")
def extract_id(spark, d):
    return code_rows(spark, d).select("id", X.extract_cve(F.col("code")).alias("cve"))


KIND = "CASE " + " ".join(f"WHEN {found('code', p)} THEN '{k}'" for k, p in K.UNSAFE.items()) + " END"
FRAMEWORK = "CASE " + " ".join(f"WHEN {found('code', [p])} THEN '{k}'" for k, p in K.FRAMEWORKS.items()) + " ELSE 'unknown' END"
SECURE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {found('code', p)}" for k, p in K.SECURE.items()) + " ELSE false END"


@query(f"""{WITH}, k AS (SELECT *, ([{", ".join(map(literal, K.SECURE))}])[(doc_id % {len(K.SECURE)} + 1)::INT] AS kind FROM v_snippets)
SELECT id, {FRAMEWORK} AS framework, {found("code", [*K.FRAMEWORKS.values(), K.REQUEST_TAINT])} AS is_web, {KIND} AS unsafe, {found("code", [K.TAINT_SOURCE])} AS taint,
contains(lower(code), 'from flask') OR contains(lower(code), 'import flask') AS flask, {found("code", [K.TAINT_SOURCE])} AND {KIND} IS NULL AND {SECURE} AS secure FROM k""")
def code_signals(spark, d):
    c, kinds = F.col("code"), list(K.SECURE)
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("doc_id") % len(kinds) + 1).cast("int"))
    return code_rows(spark, d).select("id", X.framework(c).alias("framework"), X.is_web(c).alias("is_web"), X.vulnerability(c).alias("unsafe"), c.rlike(K.TAINT_SOURCE).alias("taint"), X.imports_flask(c).alias("flask"), X.is_secure(c, kind).alias("secure"))


# the gate


TEST = rf"(regexp_matches(path, {literal(K.TEST_PATH)}) OR regexp_matches(path, '(^|/)test_[^/]*$') OR regexp_matches(path, '_test\.py$') OR regexp_matches(path, '(^|/)conftest\.py$'))"
NEAR = "CWE-22"
GATE_SQL = rf"""v_bare AS (SELECT *, regexp_replace(code, '[^\n]*#\s*(noqa\s*:\s*S311|nosec\b)[^\n]*', '', 'g') AS kept FROM v_snippets),
v_lines AS (SELECT *, {NO_COMMENTS.replace("code", "kept")} AS bare FROM v_bare),
v_near AS (SELECT *, list_transform(regexp_split_to_array(bare, '\n'), lambda x: {found("x", K.SINKS[NEAR])}) AS s, list_transform(regexp_split_to_array(bare, '\n'), lambda x: {found("x", [K.REQUEST_NEAR])}) AS r FROM v_lines),
v_gate AS (SELECT *, CASE WHEN cwe = 'CWE-79' AND {TEST} THEN false WHEN cwe = '{NEAR}' THEN len(list_filter(s, lambda x, i: x AND list_contains(r[greatest(1, i - 20):i + 20], true))) > 0
  ELSE {by_class({c: found("bare", p) for c, p in K.SINKS.items() if c != NEAR}, "true")} END AS sink_ok FROM v_near)"""


@query(f"{WITH}, {GATE_SQL} SELECT id, cwe, sink_ok AS ok FROM v_gate")
def full_gate(spark, d):
    """Comments do not count, marked lines are suppressed, path classes need request data within 20 lines."""
    return stages.gated(code_rows(spark, d)).select("id", "cwe", F.col("sink_ok").alias("ok"))


@query(rf"""{WITH}, l AS (SELECT id, cwe, unnest(regexp_split_to_array(code, '\n')) AS x, generate_subscripts(regexp_split_to_array(code, '\n'), 1) AS line FROM v_snippets),
f AS (SELECT id, line FROM l WHERE {by_class({c: found("x", [p for p in ps if not p.startswith("(?is)")]) for c, ps in K.SINKS.items()}, "false")})
SELECT s.id, count(line) AS n_lines, min(line) AS first_line FROM v_snippets s LEFT JOIN f ON s.id = f.id GROUP BY s.id""")
def class_sink_lines(spark, d):
    lines = F.lit(None).cast("array<struct<line:int,text:string>>")
    for c, patterns in K.SINKS.items():
        lines = F.when(F.col("cwe") == c, X.sink_lines(F.col("code"), [p for p in patterns if not p.startswith("(?is)")])).otherwise(lines)
    lines = F.coalesce(lines, F.array().cast("array<struct<line:int,text:string>>"))
    return code_rows(spark, d).select("id", F.size(lines).cast("long").alias("n_lines"), F.array_min(lines["line"]).cast("long").alias("first_line"))


# cleaning, refiltering, differences, purging


NORMAL = r"regexp_replace(regexp_replace(regexp_replace(code, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g')"
CLEAN_SQL = rf"""v_clean AS (SELECT *, CASE WHEN NOT regexp_matches(code, '\S') THEN 'empty' WHEN shape = {C.BROKEN} THEN 'invalid_syntax'
  WHEN len(list_filter(regexp_split_to_array(code, '\r\n|\n|\r'), lambda x: trim(x, ' ') <> '' AND NOT starts_with(trim(x, ' '), '#'))) < 5 THEN 'too_short' ELSE 'kept' END AS outcome FROM v_snippets)"""


@query(rf"""{WITH}, {CLEAN_SQL} SELECT id, outcome, contains(lower(code), 'from flask') OR contains(lower(code), 'import flask') AS has_flask_import,
CASE WHEN outcome = 'kept' THEN coalesce(upper(nullif(regexp_extract(code, '(?i)CVE-[0-9]{{4}}-[0-9]{{4,7}}'), '')), cve_id) ELSE cve_id END AS cve_id, sha256(CASE WHEN outcome = 'kept' THEN {NORMAL} ELSE code END) AS code_sha FROM v_clean""")
def validate_and_clean(spark, d):
    out = stages.validate_and_clean(code_rows(spark, d))
    return out.select("id", "outcome", "has_flask_import", "cve_id", F.sha2("code", 256).alias("code_sha"))


@query(f"{WITH}, {CLEAN_SQL} SELECT outcome, count(*) AS n FROM v_clean GROUP BY outcome")
def clean_report(spark, d):
    return stages.validate_and_clean(code_rows(spark, d)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


REFILTER_SQL = f"""{GATE_SQL}, v_reason AS (SELECT *, CASE WHEN is_hard_negative OR cwe = 'safe' THEN NULL WHEN source = 'vudenc' AND cwe = 'CWE-94' THEN 'blocked_source' WHEN NOT sink_ok THEN 'sink_absent' END AS reason FROM v_gate)"""


@query(f"{WITH}, {REFILTER_SQL} SELECT id, cwe, source, reason FROM v_reason WHERE reason IS NOT NULL")
def refilter_quarantine(spark, d):
    flagged = stages.refilter(code_rows(spark, d).select("id", "cwe", "source", "path", "is_hard_negative", "code")).drop("code")
    return flagged.filter("reason is not null").select("id", "cwe", "source", "reason")


@query(f"{WITH}, {REFILTER_SQL} SELECT coalesce(reason, 'kept') AS outcome, count(*) AS n, count(DISTINCT id) AS n_written, count(DISTINCT source) AS n_sources FROM v_reason GROUP BY 1")
def one_pass_quarantine(spark, d):
    """Refiltering that writes kept and quarantined rows and counts them in one pass, and what is read back from their partitions."""
    folder = f"{shared_folder(spark)}/refiltered-{uuid.uuid4().hex}"
    flagged = stages.refilter(code_rows(spark, d))
    manifest = stages.write_outcomes(flagged, F.col("reason"), ["blocked_source", "sink_absent"], folder)
    written = spark.read.parquet(folder).groupBy("outcome").agg(F.countDistinct("id").alias("n_written"), F.countDistinct("source").alias("n_sources"))
    return manifest.join(written, "outcome").select("outcome", "n", "n_written", "n_sources")


@query(f"""{WITH}, {REFILTER_SQL} SELECT cwe, source, count(*) AS n, count(reason) AS n_rejected, count(*) FILTER (WHERE reason = 'blocked_source') AS n_blocked,
round(100.0::DOUBLE * count(reason) / count(*), 6) AS reject_pct FROM v_reason GROUP BY GROUPING SETS ((cwe), (source), ())""")
def refilter_report(spark, d):
    return stages.refilter_report(stages.refilter(code_rows(spark, d)))


LINES = r"list_distinct(list_transform(list_filter(regexp_split_to_array({}, '\r\n|\n|\r'), lambda x: {}), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'), ' ')))"
SINK_OF = by_class({c: found("x", p) for c, p in K.SINKS.items()}, "false")
DIFF_SQL = f"""v_sides AS (SELECT *, {LINES.format("code", SINK_OF)} AS b, coalesce({LINES.format("code_after", SINK_OF)}, []) AS a FROM v_snippets WHERE cwe <> 'safe' AND source <> 'canonical' AND NOT is_hard_negative),
v_gone AS (SELECT *, list_filter(b, lambda x: NOT list_contains(a, x)) AS gone, coalesce(code_after, '') <> '' AND len(b) > 0 AS judged FROM v_sides),
v_diff AS (SELECT *, CASE WHEN judged THEN len(gone) > 0 END AS modified, CASE WHEN judged THEN list_min(gone) END AS evidence FROM v_gone)"""


@query(f"{WITH}, {DIFF_SQL} SELECT id, cwe, modified, evidence, CASE WHEN NOT modified THEN 'sink_line_unchanged' WHEN modified IS NULL THEN 'no_code_after_available' END AS reason FROM v_diff")
def diff_filter_strict(spark, d):
    return stages.diff_filter(code_rows(spark, d), strict=True).select("id", "cwe", "modified", "evidence", "reason")


@query(f"""{WITH}, {DIFF_SQL} SELECT cwe, count(*) FILTER (WHERE modified) AS kept, count(*) FILTER (WHERE NOT modified) AS dropped, count(*) FILTER (WHERE modified IS NULL) AS no_data FROM v_diff GROUP BY ROLLUP(cwe)""")
def diff_filter_report(spark, d):
    rows = stages.diff_filter(code_rows(spark, d)).select("cwe", "modified")
    return rows.rollup("cwe").agg(F.count_if("modified").alias("kept"), F.count_if(~F.col("modified")).alias("dropped"), F.count_if(F.col("modified").isNull()).alias("no_data"))


EXECUTABLE = rf"len(list_filter(regexp_split_to_array({NO_COMMENTS}, '\r\n|\n|\r'), lambda x: trim(x, ' ') <> ''))"
PURGE_SQL = rf"""v_purge AS (SELECT *, CASE WHEN shape = {C.BROKEN} THEN 'invalid Python syntax' WHEN {EXECUTABLE} <= 2 THEN 'no executable code'
  WHEN NOT {found("code", [K.AUDIT_FLASK, K.TAINT_AUDIT])} AND {found("code", [K.AUDIT_ATTACK[0]])} AND {found("code", ["(?i)(target_url|victim|http://|https://)"])} THEN 'attack script'
  WHEN NOT {by_class({c: found("code", p) for c, p in K.SUPPORT.items()}, "true")} THEN 'no support for ' || cwe END AS reason FROM v_snippets)"""


@query(f"{WITH}, {PURGE_SQL} SELECT id, cwe, reason FROM v_purge")
def purge_reasons(spark, d):
    return stages.purge(code_rows(spark, d)).select("id", "cwe", "reason")


@query(f"{WITH}, {PURGE_SQL} SELECT cwe, count(*) AS n FROM v_purge WHERE reason IS NULL OR source <> 'vudenc' GROUP BY cwe")
def purge_kept(spark, d):
    """What is left if one source's rows are purged."""
    return stages.purge(code_rows(spark, d), source="vudenc", dry_run=False).groupBy("cwe").agg(F.count(F.lit(1)).alias("n"))


# the health audit


A = {k: found("code", p) for k, p in K.AUDIT.items()}
TAINT = found("code", [K.TAINT_AUDIT])
SURE = {
    "CWE-89": f"(({A['sql_execute']} AND ({A['sql_inline']} OR {A['sql_multiline']})) OR {A['sql_orm']} OR ({A['sql_keywords']} AND {TAINT} AND {A['sql_multiline']}))",
    "CWE-78": f"({A['command_call']} AND {TAINT})",
    "CWE-22": f"({A['file_operation']} AND {TAINT})",
    "CWE-502": f"({TAINT} AND ({A['raw_deserialization']} OR ({A['yaml_load']} AND NOT {A['safe_yaml']})))",
    "CWE-79": f"({A['xss_sink']} AND {TAINT})",
    "CWE-94": f"({A['dynamic_exec']} AND {TAINT})",
    "CWE-918": f"({A['http_call']} AND {TAINT})",
}
MAYBE = {
    "CWE-89": f"({A['sql_execute']} OR ({A['sql_keywords']} AND {TAINT}))",
    "CWE-78": f"({A['command_call']} OR {A['eval_exec']})",
    "CWE-22": f"({A['file_operation']} OR {A['traversal_hint']})",
    "CWE-502": A["deserialization"],
    "CWE-79": A["xss_sink"],
    "CWE-94": A["dynamic_exec"],
    "CWE-918": A["http_call"],
}
ATTACK = " + ".join(f"{found('code', [p])}::INT" for p in K.AUDIT_ATTACK)
HEALTH_SQL = f"""v_signals AS (SELECT *, shape <> {C.BROKEN} AS valid_syntax, {EXECUTABLE} AS executable_lines, {found("code", [K.AUDIT_FLASK])} AS flask, {found("code", [K.AUDIT_ROUTE])} AS has_route_handler,
  {ATTACK} >= 2 AS attack, {TAINT} AS taint, {by_class(SURE, "NULL")} AS confident, {by_class(MAYBE, "NULL")} AS plausible FROM v_snippets),
v_health AS (SELECT *, CASE WHEN cwe = 'safe' THEN 'SKIPPED' WHEN NOT valid_syntax OR executable_lines <= 2 OR (NOT confident AND NOT plausible) THEN 'FAIL'
  WHEN (attack AND NOT flask) OR NOT confident OR (confident IS NOT NULL AND NOT taint) THEN 'WARN' ELSE 'PASS' END AS status FROM v_signals)"""


@query(f"{WITH}, {HEALTH_SQL} SELECT id, valid_syntax, executable_lines::BIGINT AS executable_lines, flask AS has_flask_import, has_route_handler, attack AS is_likely_attack, confident, plausible, status FROM v_health")
def health_audit(spark, d):
    out = stages.health_audit(code_rows(spark, d))
    return out.select("id", "valid_syntax", F.col("executable_lines").cast("long").alias("executable_lines"), "has_flask_import", "has_route_handler", "is_likely_attack", "confident", "plausible", "status")


@query(f"{WITH}, {HEALTH_SQL} SELECT status, cwe, source, count(*) AS n FROM v_health GROUP BY GROUPING SETS ((status), (cwe, status), (source, status))")
def health_rollup(spark, d):
    return stages.health_rollup(stages.health_audit(code_rows(spark, d)))


@query(f"""{WITH} SELECT id, {", ".join(f"{x} AS {k}" for k, x in A.items())}, {SURE["CWE-89"]} AS sql_confident, {MAYBE["CWE-89"]} AS sql_plausible, {A["yaml_load"]} AND NOT {A["safe_yaml"]} AS unsafe_yaml FROM v_snippets""")
def class_signals(spark, d):
    """Every signal of every class's check, as columns."""
    out = stages.class_signal_columns(code_rows(spark, d))
    signal = lambda c, k: F.col(f"{K.CLASS_SLUGS[c]}.has_{k}").alias(k)
    return out.select("id", *(signal(c, k) for c, ks in curate.CLASS_SIGNALS.items() for k in ks), F.col("sql_injection.confident").alias("sql_confident"), F.col("sql_injection.plausible").alias("sql_plausible"), F.col("insecure_deserialization.has_unsafe_yaml").alias("unsafe_yaml"))


# inserts, configuration, exports


@query(f"""{WITH}, {GATE_SQL}, v_in AS (SELECT *, substr(sha256(code), 1, 16) AS content_hash, cwe IN ('CWE-89', 'CWE-78', 'CWE-22') AS scope FROM v_gate WHERE doc_id % 3 <> 0),
v_first AS (SELECT *, row_number() OVER (PARTITION BY content_hash, scope AND sink_ok ORDER BY id) AS k FROM v_in)
SELECT id, cwe, content_hash, CASE WHEN NOT scope THEN 'out_of_scope' WHEN NOT sink_ok THEN 'rejected' WHEN k > 1 OR content_hash IN (SELECT substr(sha256(code), 1, 16) FROM v_snippets WHERE doc_id % 3 = 0) THEN 'present' ELSE 'inserted' END AS action FROM v_first""")
def canonical_insert(spark, d):
    rows = code_rows(spark, d)
    return stages.canonical_insert(rows.filter("doc_id % 3 = 0"), rows.filter("doc_id % 3 <> 0"), ["CWE-89", "CWE-78", "CWE-22"])


@query(f"""{WITH}, n AS (SELECT cwe, count(*) AS n FROM v_snippets WHERE doc_id % 10 < 7 GROUP BY cwe), r AS (SELECT cwe, n, (1 - 0.9999::DOUBLE) / (1 - pow(0.9999::DOUBLE, n)) AS raw FROM n)
SELECT cwe, n, round(raw * count(*) OVER () / sum(raw) OVER (), 9) AS weight FROM r""")
def training_config(spark, d):
    """Class weights counted from the training rows alone."""
    rows = code_rows(spark, d).select("cwe", F.when(F.col("doc_id") % 10 < 7, "train").otherwise("test").alias("split"))
    return stages.training_config(rows).select("cwe", "n", F.round("weight", 9).alias("weight"))


TRIMMED = r"list_filter(list_transform(regexp_split_to_array({}, '\r\n|\n|\r'), lambda x: trim(x, ' ')), lambda x: x <> '')"


@query(rf"""{WITH}, e AS (SELECT *, {TRIMMED.format("code")} AS b, {TRIMMED.format("code_after")} AS a FROM v_snippets WHERE cwe <> 'safe' AND coalesce(code_after, '') <> '')
SELECT id, cwe, row_number() OVER (PARTITION BY cwe ORDER BY id) AS folder_index, sha256(array_to_string(list_sort(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x)))), chr(10))) AS snippet_sha,
len(list_filter(regexp_split_to_array(code, '\r\n|\n|\r'), lambda x: {SINK_OF})) AS n_sinks FROM e""")
def export_triples(spark, d):
    out = stages.export_triples(code_rows(spark, d))
    return out.select("id", "cwe", "folder_index", F.sha2("snippet", 256).alias("snippet_sha"), F.size("sink_lines").cast("long").alias("n_sinks"))


@query(f"""{WITH}, h AS (SELECT id, substr(sha256(code), 1, 16) AS content_hash, cve_id FROM v_snippets)
SELECT 'id' AS key, (SELECT count(*) FROM (SELECT id FROM h WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)) AS n_duplicated, (SELECT count(*) FROM h WHERE id IS NULL) AS n_null
UNION ALL SELECT 'content_hash', (SELECT count(*) FROM (SELECT 1 FROM h GROUP BY content_hash HAVING count(*) > 1)), 0
UNION ALL SELECT 'cve_id', (SELECT count(*) FROM (SELECT 1 FROM h WHERE cve_id IS NOT NULL GROUP BY cve_id HAVING count(*) > 1)), (SELECT count(*) FROM h WHERE cve_id IS NULL)""")
def unique_keys(spark, d):
    rows = code_rows(spark, d).select("id", X.code_hash(F.col("code")).alias("content_hash"), "cve_id")
    return stages.uniqueness(rows, ["id", "content_hash", "cve_id"])


@query(f"{WITH} SELECT DISTINCT substr(sha256(code), 1, 16) AS content_hash FROM v_snippets")
def seen_hashes(spark, d):
    return code_rows(spark, d).select(X.code_hash(F.col("code")).alias("content_hash")).distinct()


@query("SELECT strftime(ts, '%Y%m%dT%H%M%SZ') AS tag, count(*) AS n FROM events GROUP BY 1")
def timestamp_tags(spark, d):
    from ..sources.relations import read

    return read(spark, d, "events").groupBy(stages.timestamp_tag(F.col("ts")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH} SELECT id, cwe, row_number() OVER (PARTITION BY cwe ORDER BY id) AS r FROM v_snippets")
def ordered_rank(spark, d):
    return split.ordered_rank(code_rows(spark, d).select("id", "cwe"), "cwe", "id")


# detectors, assembled examples, score vectors


RULE_IDS = [*K.RULES, "B101", "B404"]
RULE_SQL = "CASE rule " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.RULES.items()) + " END"


def _reports(spark, d):
    """A rule report, a SARIF report and an answer about each document, some without findings."""
    i = F.col("doc_id")
    rule = lambda n: F.element_at(F.array(*map(F.lit, RULE_IDS)), ((i * n) % len(RULE_IDS) + 1).cast("int"))
    rows = code_rows(spark, d).select("id", "doc_id", "cwe")
    results = F.when(i % 5 == 0, F.array().cast("array<struct<filename:string,test_id:string,line_number:bigint>>")).otherwise(F.array(*(F.struct(F.col("id").alias("filename"), rule(n).alias("test_id"), i.alias("line_number")) for n in (3, 7))))
    tag = F.format_string("external/cwe/cwe-%03d", F.element_at(F.array(*(F.lit(int(k)) for k in K.FOLD)), (i % len(K.FOLD) + 1).cast("int")))
    rules = F.array(F.struct(F.lit("r1").alias("id"), F.struct(F.array(tag, F.lit("security")).alias("tags")).alias("properties")), F.struct(F.lit("r2").alias("id"), F.struct(F.array(F.lit("external/cwe/cwe-089")).alias("tags")).alias("properties")))
    hits = F.array(F.struct(F.when(i % 3 == 0, "r1").when(i % 3 == 1, "r2").otherwise("r3").alias("ruleId"), F.array(F.struct(F.struct(F.struct(F.col("id").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))).alias("locations")))
    run = F.struct(F.struct(F.struct(rules.alias("rules")).alias("driver")).alias("tool"), hits.alias("results"))
    answer = F.when(i % 4 == 0, "safe").otherwise(F.concat(F.lit("<think>CWE-22\nor not</think>\nCWE-"), F.element_at(F.array(*map(F.lit, K.FOLD)), (i % len(K.FOLD) + 1).cast("int")), F.lit(" in line 3")))
    return rows, {"rules": F.to_json(F.struct(results.alias("results"))), "sarif": F.to_json(F.struct(F.array(run).alias("runs"))), "verdict": answer}


FOLDED = "([" + ", ".join(map(literal, K.FOLD.values())) + f"])[(doc_id % {len(K.FOLD)} + 1)::INT]"
RULE_LIST = "[" + ", ".join(map(literal, RULE_IDS)) + "]"


@query(f"""{WITH}, r AS (SELECT id, cwe, doc_id, unnest([({RULE_LIST})[(doc_id * 3 % {len(RULE_IDS)} + 1)::INT], ({RULE_LIST})[(doc_id * 7 % {len(RULE_IDS)} + 1)::INT]]) AS rule FROM v_snippets),
f AS (SELECT 'rules' AS tool, id, CASE WHEN doc_id % 5 <> 0 THEN {RULE_SQL} END AS c FROM r UNION SELECT 'sarif', id, CASE doc_id % 3 WHEN 0 THEN {FOLDED} WHEN 1 THEN 'CWE-89' END FROM v_snippets
  UNION SELECT 'verdict', id, CASE WHEN doc_id % 4 <> 0 THEN {FOLDED} END FROM v_snippets)
SELECT tool, s.id AS sample_id, cwe AS ground_truth, coalesce(string_agg(c, '|' ORDER BY c), '') AS predicted FROM f JOIN v_snippets s ON s.id = f.id GROUP BY tool, s.id, cwe""")
def detector_records(spark, d):
    """Raw reports of three kinds of tools through the registry of detectors."""
    rows, reports = _reports(spark, d)
    samples = rows.select(F.col("id").alias("sample_id"), F.col("cwe").alias("ground_truth"))
    out = None
    for name, report in reports.items():
        one = detectors.records(samples, rows.select(F.col("id").alias("sample_id"), report.alias("report")), name, "1")
        out = one if out is None else out.unionByName(one)
    return out.select("tool", "sample_id", "ground_truth", F.array_join("predicted", "|").alias("predicted"))


@query("SELECT vec_id AS id, 'CVSS:3.1/' || " + " || '/' || ".join(f"'{k}:' || substr('{v}', ((vec_id + label * {i + 1}) % {len(v)} + 1)::INT, 1)" for i, (k, v) in enumerate(K.CVSS_LETTERS.items())) + " AS vector FROM embeddings")
def score_vectors(spark, d):
    """Score vectors of predicted option numbers."""
    from ..sources.relations import read

    codes = F.array(*(((F.col("vec_id") + F.col("label") * (i + 1)) % len(v)).cast("int") for i, v in enumerate(K.CVSS_LETTERS.values())))
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), detectors.score_codes(codes, K.CVSS_LETTERS).alias("vector"))
