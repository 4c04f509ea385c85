"""Queries of parsers, lookups and text functions over whole tables, with SQL that computes the same from the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import syntax
from ..functions import text as X
from ..operators import advisory
from ..sources import relations as R
from ..sources import tables
from ..sources.relations import literal
from .curation import FOLDED, RULE_IDS, RULE_LIST, RULE_SQL, TEST, WITH, _reports, code_rows
from .registry import query

LINES = r"regexp_split_to_array(code, '\r\n|\n|\r')"
FOLD_SQL = "CASE n " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in K.FOLD.items()) + " END"


@query(rf"""{WITH}, l AS (SELECT id, {LINES} AS ls, doc_id % 5 + 1 AS line, greatest(doc_id % 5 - 1, 1) AS s FROM v_snippets)
SELECT id, sha256(array_to_string(list_transform(ls[s:line + 2], lambda x, i: CASE WHEN s + i - 1 = line THEN '> ' ELSE '  ' END || (s + i - 1) || ': ' || x), chr(10))) AS shown FROM l""")
def excerpt(spark, d):
    line = (F.col("doc_id") % 5 + 1).cast("int")
    return code_rows(spark, d).select("id", F.sha2(X.excerpt(F.col("code"), line, 2), 256).alias("shown"))


@query(f"""{WITH} SELECT id, coalesce(lower(nullif(CASE WHEN doc_id % 5 = 0 THEN '' ELSE cve_id END, '')), CASE WHEN doc_id % 3 = 0 THEN 'ghsa-' || doc_id END, 'nocve-' || substr(sha256(code), 1, 16)) AS slug FROM v_snippets""")
def slugs(spark, d):
    i = F.col("doc_id")
    cve, ghsa = F.when(i % 5 == 0, "").otherwise(F.col("cve_id")), F.when(i % 3 == 0, F.concat(F.lit("GHSA-"), i.cast("string")))
    return code_rows(spark, d).select("id", X.slug(cve, ghsa, F.col("code")).alias("slug"))


@query(f"""{WITH}, g AS (SELECT id, CASE greatest(doc_id % 7, doc_id * 3 % 7) WHEN 3 THEN 'CWE-94' WHEN 5 THEN 'CWE-89' END AS cwe, trim(array_to_string({LINES}, ''), ' ') AS t FROM v_snippets)
SELECT id, cwe, length(t) AS n FROM g WHERE cwe IS NOT NULL AND length(t) >= 30""")
def line_labels(spark, d):
    i = F.col("doc_id")
    rows = code_rows(spark, d).select("id", X.lines(F.col("code")).alias("raw_lines"), F.array((i % 7).cast("int"), (i * 3 % 7).cast("int")).alias("labels"))
    return tables.line_labels(rows, {3: "CWE-94", 5: "CWE-89"}).select("id", "cwe", F.length("code").cast("long").alias("n"))


TWO_RULES = f"SELECT id, doc_id, unnest([({RULE_LIST})[(doc_id * 3 % {len(RULE_IDS)} + 1)::INT], ({RULE_LIST})[(doc_id * 7 % {len(RULE_IDS)} + 1)::INT]]) AS rule FROM v_snippets WHERE doc_id % 5 <> 0"


@query(f"{WITH} SELECT id AS path, rule FROM ({TWO_RULES})")
def scan_reports(spark, d):
    rows, reports = _reports(spark, d)
    return advisory.scan_findings(rows.select(reports["rules"].alias("json")))


@query(f"""{WITH}, r AS (SELECT id, {RULE_SQL} AS c FROM ({TWO_RULES})) SELECT s.id AS sample_id, coalesce(string_agg(DISTINCT c, '|' ORDER BY c), '') AS predicted FROM v_snippets s LEFT JOIN r ON r.id = s.id GROUP BY s.id""")
def findings_fold(spark, d):
    rows, reports = _reports(spark, d)
    found = advisory.scan_findings(rows.select(reports["rules"].alias("json"))).select(F.concat(F.lit("/tmp/x/"), "path", F.lit(".py")).alias("path"), "rule")
    return advisory.fold_findings(rows.select(F.col("id").alias("sample_id")), found).select("sample_id", F.array_join("predicted", "|").alias("predicted"))


@query(f"{WITH}, r AS (SELECT id, CASE doc_id % 3 WHEN 0 THEN {FOLDED} WHEN 1 THEN 'CWE-89' END AS cwe FROM v_snippets) SELECT id AS path, cwe FROM r WHERE cwe IS NOT NULL")
def sarif_reports(spark, d):
    rows, reports = _reports(spark, d)
    return advisory.sarif_findings(rows.select(reports["sarif"].alias("json")))


@query(f"""WITH r AS (SELECT doc_id AS id, 'CVE-' || (doc_id % 60) AS cve_id FROM documents), c AS (SELECT 'CVE-' || (doc_id % 75) AS cve_id, doc_id // 75 AS ordinal, 'CWE-' || ([20, 79, 89, 1, 22])[(doc_id % 11 % 5 + 1)::INT] AS cwe FROM documents)
SELECT id, (SELECT min_by(cwe, ordinal) FROM c WHERE c.cve_id = r.cve_id AND cwe IN ({", ".join(map(literal, K.TARGETS))})) AS cwe FROM r""")
def class_lookup(spark, d):
    i = F.col("doc_id")
    docs = R.read(spark, d, "documents").select("doc_id")
    number = F.element_at(F.array(*map(F.lit, ["20", "79", "89", "1", "22"])), (i % 11 % 5 + 1).cast("int"))
    classes = docs.select(F.concat(F.lit("CVE-"), (i % 75).cast("string")).alias("cve_id"), F.floor(i / 75).alias("ordinal"), F.concat(F.lit("CWE-"), number).alias("cwe"))
    return advisory.first_class(docs.select(i.alias("id"), F.concat(F.lit("CVE-"), (i % 60).cast("string")).alias("cve_id")), classes).select("id", "cwe")


@query(f"{WITH} SELECT id, sha256(trim(split_part(code, '(', 1), ' ')) AS issue_sha FROM v_snippets")
def issue_keys(spark, d):
    return code_rows(spark, d).select("id", F.sha2(X.issue_key(F.col("code")), 256).alias("issue_sha"))


HINTS = r"(?i)\bpython\b|pypi\.org|\bdjango\b|\bflask\b|\.py\b"


@query(f"{WITH} SELECT id, (doc_id % 2 = 0 AND regexp_matches(code, {literal(HINTS)})) OR doc_id % 9 = 0 AS relevant FROM v_snippets")
def language_hints(spark, d):
    i = F.col("doc_id")
    said = F.array(F.struct(F.when(i % 2 == 0, "en").otherwise("fr").alias("lang"), F.col("code").alias("value")))
    return code_rows(spark, d).select("id", X.names_python(said, F.array(F.when(i % 9 == 0, "https://pypi.org/p").otherwise("x")), HINTS).alias("relevant"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 100 / 10.0::DOUBLE WHEN doc_id % 4 = 0 THEN doc_id % 90 / 10.0::DOUBLE WHEN doc_id % 5 = 0 THEN doc_id % 80 / 10.0::DOUBLE END AS score FROM documents")
def preferred_scores(spark, d):
    i = F.col("doc_id")
    none = F.array().cast("array<double>")
    v = [F.when(i % m == 0, F.array(i % top / 10.0)).otherwise(none if m == 3 else F.lit(None)) for m, top in ((3, 100), (4, 90), (5, 80))]
    return R.read(spark, d, "documents").select(i.alias("id"), advisory.preferred_score(*v).alias("score"))


PATTERNS = [r"return \w+", r"eval\(", r"(?i)OPEN\("]


@query(f"""{WITH}, m AS (SELECT id, code, strpos(code, nullif(CASE doc_id % 3 WHEN 0 THEN regexp_extract(code, {literal(PATTERNS[0])}) WHEN 1 THEN regexp_extract(code, {literal(PATTERNS[1])}) ELSE regexp_extract(code, {literal(PATTERNS[2])}) END, '')) AS pos FROM v_snippets)
SELECT id, (length(substr(code, 1, pos)) - length(replace(substr(code, 1, pos), chr(10), '')) + 1)::INT AS line FROM m""")
def recorded_sinks(spark, d):
    pattern = F.element_at(F.array(*map(F.lit, PATTERNS)), (F.col("doc_id") % 3 + 1).cast("int"))
    return code_rows(spark, d).select("id", X.recorded_line(F.col("code"), pattern).alias("line"))


@query(f"""{WITH}, p AS (SELECT doc_id, path, regexp_replace(coalesce(text, ''), '\\r', ' ', 'g') AS t FROM v_snippets JOIN documents USING (doc_id))
SELECT doc_id AS id, sha256(t || chr(10) || 'old' || doc_id) AS before_sha, sha256(t || chr(10) || 'new' || doc_id) AS after_sha FROM p WHERE NOT {TEST} AND doc_id % 3 <> 0""")
def diff_pairs(spark, d):
    """Both sides of differences that hold whole texts as context; where nothing changes, or in tests, there is no pair."""
    i = F.col("doc_id").cast("string")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r", " ")
    diff = F.concat(F.lit("--- a/x\n+++ b/x\n@@ -1 +1 @@\n "), F.regexp_replace(text, "\n", "\n "), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("\n-old"), i, F.lit("\n+new"), i)))
    rows = code_rows(spark, d).select("doc_id", "path").join(R.read(spark, d, "documents").select("doc_id", "text"), "doc_id").select(F.col("doc_id").alias("id"), "path", diff.alias("diff"))
    return advisory.diff_pairs(rows).select("id", F.sha2("code_before", 256).alias("before_sha"), F.sha2("code_after", 256).alias("after_sha"))


@query("""SELECT 'G-' || doc_id AS id, doc_id % 3 <> 0 AS is_python, CASE doc_id % 4 WHEN 0 THEN 'CWE-89' WHEN 1 THEN 'CWE-79' END AS cve_class, CASE WHEN doc_id % 2 = 0 THEN 'CVE-' || doc_id END AS cve_id,
array_to_string(list_filter(['o' || (doc_id % 7) || '/r' || doc_id || '@' || substr(sha256('a' || doc_id), 1, 10), CASE WHEN doc_id % 5 <> 0 THEN 'o/g' || doc_id || '@' || substr(sha256('b' || doc_id), 1, 12) END], lambda x: x IS NOT NULL), ',') AS commits FROM documents""")
def advisory_commits(spark, d):
    """Advisories as JSON, parsed again."""
    i = F.col("doc_id")
    n = i.cast("string")
    sha = lambda letter, size: F.substring(F.sha2(F.concat(F.lit(letter), n), 256), 1, size)
    url = F.concat(F.lit("https://github.com/o"), (i % 7).cast("string"), F.lit("/r"), n, F.lit("/commit/"), sha("a", 10))
    ids = F.when(i % 4 == 0, F.array(F.lit("CWE-20"), F.lit("CWE-89"), F.lit("CWE-79"))).when(i % 4 == 1, F.array(F.lit("CWE-79"))).otherwise(F.array(F.lit("CWE-1")))
    git = F.struct(F.when(i % 5 == 0, "SEMVER").otherwise("GIT").alias("type"), F.concat(F.lit("https://github.com/o/g"), n, F.lit(".git")).alias("repo"), F.array(F.struct(F.lit("0").alias("introduced"), F.lit(None).cast("string").alias("fixed")), F.struct(F.lit(None).cast("string").alias("introduced"), sha("b", 12).alias("fixed"))).alias("events"))
    package = F.struct(F.lit("p").alias("name"), F.when(i % 3 == 0, "npm").when(i % 3 == 1, "PyPI").otherwise("pypi").alias("ecosystem"))
    row = F.struct(
        F.concat(F.lit("G-"), n).alias("id"),
        F.when(i % 2 == 0, F.array(F.lit("GHSA-x"), F.concat(F.lit("CVE-"), n))).otherwise(F.array(F.lit("GHSA-x"))).alias("aliases"),
        F.array(F.struct(url.alias("url")), F.struct(F.lit("https://x.org").alias("url")), F.struct(url.alias("url"))).alias("references"),
        F.array(F.struct(package.alias("package"), F.array(git).alias("ranges"))).alias("affected"),
        F.struct(ids.alias("cwe_ids"), F.lit("HIGH").alias("severity")).alias("database_specific"),
    )
    a = advisory.parse(R.read(spark, d, "documents").select(F.to_json(row).alias("json")))
    return a.select("id", advisory.is_python(F.col("affected")).alias("is_python"), advisory.first_target(F.col("database_specific.cwe_ids")).alias("cve_class"), advisory.cve_alias(F.col("aliases")).alias("cve_id"), F.array_join(advisory.fix_commits(F.col("references"), F.col("affected")), ",").alias("commits"))


@query("""WITH f AS (SELECT 'h' || l_orderkey AS hash, 'f' || l_linenumber || CASE WHEN l_linenumber % 2 = 0 THEN '.py' ELSE '.js' END AS filename, CASE WHEN l_linenumber <> 4 THEN l_comment END AS code_before FROM (SELECT *, 'x' AS l_comment FROM lineitem))
SELECT DISTINCT f.hash, f.filename, 'CVE-' || o_custkey AS cve_id, CASE c_custkey % 10 WHEN 0 THEN 'CWE-89' ELSE 'CWE-79' END AS cwe_id FROM f JOIN orders ON f.hash = 'h' || o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE f.filename LIKE '%.py' AND c_custkey % 10 IN (0, 1) AND f.code_before IS NOT NULL""")
def cve_table_scan(spark, d):
    """Files of fixes of target classes out of four joined tables."""
    r = lambda n: R.read(spark, d, n)
    name = F.concat(F.lit("f"), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, ".py").otherwise(".js"))
    files = r("lineitem").select(F.concat(F.lit("h"), F.col("l_orderkey").cast("string")).alias("hash"), name.alias("filename"), F.when(F.col("l_linenumber") != 4, "x").alias("code_before"))
    orders = r("orders").select(F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("hash"), F.concat(F.lit("CVE-"), F.col("o_custkey").cast("string")).alias("cve_id"))
    n = F.col("c_custkey") % 10
    classes = r("customer").select(F.concat(F.lit("CVE-"), F.col("c_custkey").cast("string")).alias("cve_id"), F.when(n == 0, "CWE-89").when(n == 1, "CWE-79").otherwise("CWE-20").alias("cwe_id"))
    return advisory.fixed_files(files, orders.select("hash"), orders, classes, ["CWE-89", "CWE-79"]).select("hash", "filename", "cve_id", "cwe_id")


@query(f"""WITH r AS (SELECT doc_id AS id, doc_id % 1000 AS n FROM documents) SELECT id, {FOLD_SQL} AS cwe FROM r""")
def normalize_cwe(spark, d):
    i = F.col("doc_id")
    n = (i % 1000).cast("string")
    raw = F.when(i % 3 == 0, F.concat(F.lit("cwe-"), n)).when(i % 3 == 1, F.concat(F.lit(" CWE-"), n, F.lit(": Words"))).otherwise(n)
    return R.read(spark, d, "documents").select(i.alias("id"), X.normalize_class(raw).alias("cwe"))


@query(f"""WITH r AS (SELECT doc_id AS id, 'B' || (100 + doc_id % 700) AS rule FROM documents) SELECT id, {RULE_SQL} AS cwe FROM r""")
def rule_map(spark, d):
    i = F.col("doc_id")
    rule = F.concat(F.when(i % 2 == 0, " b").otherwise("B"), (i % 700 + 100).cast("string"), F.lit(" "))
    return R.read(spark, d, "documents").select(i.alias("id"), X.rule_class(rule).alias("cwe"))


@query(f"""WITH r AS (SELECT doc_id AS id, doc_id, ([{", ".join(K.FOLD)}, 20, 327])[(doc_id % {len(K.FOLD) + 2} + 1)::INT] AS n FROM documents)
SELECT id, CASE doc_id % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE {FOLD_SQL} END AS cwe FROM r""")
def verdict_parse(spark, d):
    """Answers with a verdict in the first line, behind thoughts or in the last line, and ones without; whole texts stand in some."""
    i = F.col("doc_id")
    n = F.element_at(F.array(*map(F.lit, [*K.FOLD, "20", "327"])), (i % (len(K.FOLD) + 2) + 1).cast("int"))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[\n\r<>]", " ")
    said = F.when(i % 5 == 0, F.concat(F.lit("CWE-"), n, F.lit("\n> "), text)).when(i % 5 == 1, F.concat(F.lit("<think>CWE-22 "), text, F.lit("</think>\ncwe "), n, F.lit(" found"))).when(i % 5 == 2, F.concat(F.lit("Let me see.\n> "), text, F.lit("\nCWE-"), n))
    said = said.when(i % 5 == 3, F.concat(F.lit("safe\n> "), text)).otherwise(F.concat(F.lit("It names CWE-89 inside a line. "), text))
    return R.read(spark, d, "documents").select(i.alias("id"), F.try_element_at(X.parse_response(X.strip_thinking(said)), F.lit(1)).alias("cwe"))


@query(f"""{WITH} SELECT id, CASE WHEN shape <> 13 THEN '@app.route(''/x' || doc_id || ''')' || chr(10) || 'def x():' || chr(10) || '    return ' || doc_id END AS route FROM v_snippets""")
def routes(spark, d):
    """The route in front of each program that parses."""
    n = F.col("doc_id").cast("string")
    code = F.concat(F.lit("@app.route('/x"), n, F.lit("')\ndef x():\n    return "), n, F.lit("\n\n"), F.col("code"))
    return code_rows(spark, d).select("id", syntax.routes_udf(code).alias("r")).select("id", F.explode_outer("r").alias("route"))
