"""Parsers, lookups and text functions on cases written by hand."""

from pyspark.sql import functions as F

from quarry.functions import constants as K
from quarry.functions import text as X
from quarry.operators import advisory, stages
from quarry.sources import tables

SNIPPET_DDL = "id int, cwe string, path string, code string"
SNIPPETS = [
    (1, "CWE-89", "app/db.py", 'from flask import request\n\ndef find(cur):\n    name = request.args["q"]\n    cur.execute(f"SELECT * FROM t WHERE n = {name}")\n    return cur\n'),
    (2, "CWE-89", "app/db.py", "def total(xs):\n    out = 0\n    for x in xs:\n        out += x\n    return out\n"),
    (3, "CWE-79", "tests/test_view.py", "def show(x):\n    y = mark_safe(x)\n    return y\n"),
    (4, "CWE-79", "app/view.py", "def show(x):\n    y = mark_safe(x)\n    return y\n"),
    (5, "CWE-78", "app/run.py", "import os\n\ndef go(request):\n    os.system(request.form['c'])\n    return 0\n"),
    (6, "CWE-22", "app/files.py", "def load(request):\n    with open(request.args['p']) as f:\n        return f.read()\n"),
    (7, "CWE-22", "app/files.py", "def load(name):\n    with open(name) as f:\n        return f.read()\n"),
    (8, "CWE-502", "app/io.py", "import pickle\n\ndef load(raw):\n    return pickle.loads(raw)\n"),
    (9, "CWE-918", "tool/send.py", "import requests\n\ndef go(target_url):\n    payload = {'a': 1}\n    requests.post(target_url, payload)\n"),
    (10, "safe", "app/ok.py", "def ok():\n    a = 1\n    b = 2\n    return a + b\n"),
    (11, "CWE-94", "app/ev.py", '"""eval( is only named here"""\n'),
    (12, "CWE-94", "app/ev.py", "def calc(request):\n    x = request.json['e']\n    return eval(x)\n"),
]
PAIRS = [
    (1, "a = 1\ncur.execute(q + x)\n", "a = 1\ncur.execute(q, (x,))\n"),
    (2, "cur.execute(q)\nb = 2\n", "  cur.execute(q)\nb = 3\n"),
    (3, "a = 1\n", "a = 2\n"),
    (4, "cur.execute(q)\n", ""),
    (5, "z.execute(b)\na.execute(c)\n", "pass\n"),
]
PAIRS_WANT = [(1, True, "cur.execute(q + x)"), (2, False, None), (3, None, None), (4, None, None), (5, True, "a.execute(c)")]
EXCERPTS = [(1, "a\nb\nc\nd\ne\nf", 3), (2, "a\nb", 1)]
EXCERPT_WANT = [(1, "  1: a\n  2: b\n> 3: c\n  4: d\n  5: e"), (2, "> 1: a\n  2: b")]
RAW_IDS = [
    ("80", "CWE-79"), ("83", "CWE-79"), ("77", "CWE-78"), ("95", "CWE-94"), ("96", "CWE-94"), ("23", "CWE-22"), ("564", "CWE-89"),
    ("CWE-502: Deserialization", "CWE-502"), ("cwe-89", "CWE-89"), (" CWE-918 ", "CWE-918"), ("327", None), ("20", None), ("0", None), ("", None), ("safe", None), ("CWE-", None), (None, None),
]
RULE_IDS = [("B608", "CWE-89"), ("B703", "CWE-79"), ("b608", "CWE-89"), (" B602 ", "CWE-78"), ("B307", "CWE-94"), ("B301", "CWE-502"), ("B310", "CWE-918"), ("B404", None), ("B101", None), ("B999", None), (None, None)]
ANSWERS = [
    (1, "CWE-89\nThe query is built from input."),
    (2, "safe - nothing found"),
    (3, "\n\n  cwe 79 reflected"),
    (4, "Let me think.\nCWE-22 maybe\nno.\nCWE-78"),
    (5, "Let me think.\nCWE-22\nSafe after all"),
    (6, "CWE-327 weak hash"),
    (7, "It mentions CWE-89 inside a line."),
    (8, ""),
    (9, "<think>CWE-89\nhm</think>\nCWE-918"),
    (10, "<THINK mode=1>a</THINK>safe"),
]
ANSWERS_WANT = [(1, "CWE-89"), (2, None), (3, "CWE-79"), (4, "CWE-78"), (5, None), (6, None), (7, None), (8, None), (9, "CWE-918"), (10, None)]
ADVISORIES = [
    ('{"id":"G-1","aliases":["GHSA-x","CVE-2020-1"],"references":[{"url":"https://github.com/o/r/commit/abcdef1234"},{"url":"https://x.org"},{"url":"https://github.com/o/r/commit/abcdef1234"}],'
     '"affected":[{"package":{"name":"p","ecosystem":"PyPI"},"ranges":[{"type":"GIT","repo":"https://github.com/o/r.git","events":[{"introduced":"0"},{"fixed":"fedcba9876"}]}]}],"database_specific":{"cwe_ids":["CWE-20","CWE-89","CWE-79"],"severity":"HIGH"}}',),
    ('{"id":"G-2","aliases":[],"references":[],"affected":[{"package":{"name":"q","ecosystem":"npm"},"ranges":[]}],"database_specific":{"cwe_ids":["CWE-1"],"severity":"LOW"}}',),
    ('{"id":"G-3","affected":[{"package":{"name":"q","ecosystem":"pypi"}}]}',),
]
ADVISORY_WANT = [("G-1", True, "CWE-89", "CVE-2020-1", "o/r@abcdef1234,o/r@fedcba9876"), ("G-2", False, None, None, ""), ("G-3", True, None, None, "")]
SCANNED = [("s1",), ("s2",), ("s3",)]
FINDINGS = [("/tmp/x/s1.py", "B608"), ("/tmp/x/s1.py", "B102"), ("/tmp/x/s1.py", "B608"), ("s2.py", "B101"), ("/tmp/x/other.py", "B608")]
FINDINGS_WANT = [("s1", "CWE-89|CWE-94"), ("s2", ""), ("s3", "")]
SARIF = [(1, ["security", "external/cwe/cwe-089", "external/cwe/cwe-564"]), (2, ["external/cwe/cwe-20"]), (3, ["external/cwe/cwe-078", "external/cwe/cwe-094"]), (4, [])]
SARIF_WANT = [(1, "CWE-89"), (2, ""), (3, "CWE-78|CWE-94"), (4, "")]
DIFFS = [
    (1, "a.py", "--- a/a.py\n+++ b/a.py\n@@ -1,2 +1,2 @@\n keep\n-old\n+new"),
    (2, "tests/a.py", "@@\n-old\n+new"),
    (3, "b.js", "@@\n-old\n+new"),
    (4, "c.py", "@@\n same"),
]
DIFFS_WANT = [(1, "keep\nold", "keep\nnew")]
SLUGS = [(1, "CVE-2020-1", "GHSA-A", "x"), (2, "", "GHSA-B", "x"), (3, None, None, "x")]
SLUGS_WANT = [(1, "cve-2020-1"), (2, "ghsa-b"), (3, "nocve-2d711642b726b044")]
LABELLED_LINES = [("a", ["def f():\n", "    return eval(x)  # 30 or more\n"], [0, 3]), ("b", ["short"], [3]), ("c", ["y" * 40], [0]), ("d", ["z" * 40], [5])]
LABELLED_WANT = [("a", "CWE-94"), ("d", "CWE-89")]
SCANS = [('{"results": [{"filename": "/t/s1.py", "test_id": "B608", "line_number": 3}, {"filename": "/t/s2.py", "test_id": "B101"}]}',), ('{"results": []}',)]
SCANS_WANT = [("/t/s1.py", "B608"), ("/t/s2.py", "B101")]
SARIFS = [
    ('{"runs": [{"tool": {"driver": {"rules": [{"id": "r1", "properties": {"tags": ["external/cwe/cwe-089"]}}, {"id": "r2", "properties": {"cwe": ["CWE-79", "CWE-20"]}}]}},'
     '"results": [{"ruleId": "r1", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "s1.py"}}}]}, {"ruleId": "r2", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "s2.py"}}}]}]}]}',),
]
SARIFS_WANT = [("s1.py", "CWE-89"), ("s2.py", "CWE-79")]
CVES = [("r1", "CVE-1"), ("r2", "CVE-2"), ("r3", None)]
CVE_CLASSES = [("CVE-1", 1, "CWE-20"), ("CVE-1", 2, "CWE-79"), ("CVE-1", 3, "CWE-89"), ("CVE-2", 1, "CWE-20")]
CVE_CLASSES_WANT = [("r1", "CWE-79"), ("r2", None), ("r3", None)]
ISSUES = [("label CWE-1 not supported (false label?)",), ("plain issue",), ("a (b) c (d)",)]
ISSUES_WANT = [("label CWE-1 not supported",), ("plain issue",), ("a",)]
HINTS = [(1, "en", "A bug in Django", "x"), (2, "fr", "Un bug Django", "x"), (3, "en", "A bug in C", "https://pypi.org/p"), (4, "en", "none", "none")]
HINTS_WANT = [(1, True), (2, False), (3, True), (4, False)]
SCORES = [(1, [9.8], [8.0], [7.0]), (2, [], [8.1], [7.0]), (3, None, [], [6.4]), (4, None, None, None)]
SCORES_WANT = [(1, 9.8), (2, 8.1), (3, 6.4), (4, None)]
RECORDED = [(1, "a = 1\nb = run(x)\n", "run\\("), (2, "nothing", "run\\("), (3, "eval(x)", "(?i)EVAL")]
RECORDED_WANT = [(1, 2), (2, None), (3, 1)]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def want(rows):
    return sorted(rows, key=str)


def test_programs_through_the_stages(spark):
    rows = spark.createDataFrame(SNIPPETS, SNIPPET_DDL).withColumns({"source": F.lit("s"), "cve_id": F.lit(None).cast("string"), "is_hard_negative": F.lit(False), "code_after": F.lit("")})
    ok = {r["id"]: r["sink_ok"] for r in stages.gated(rows).collect()}
    assert ok == {1: True, 2: False, 3: False, 4: True, 5: True, 6: True, 7: False, 8: True, 9: True, 10: True, 11: False, 12: True}
    reasons = {r["id"]: r["reason"] for r in stages.purge(rows).collect() if r["reason"]}
    assert reasons == {2: "no support for CWE-89", 9: "attack script", 11: "no executable code"}
    status = {r["id"]: r["status"] for r in stages.health_audit(rows).collect()}
    assert status == {1: "PASS", 2: "FAIL", 3: "WARN", 4: "WARN", 5: "PASS", 6: "PASS", 7: "WARN", 8: "WARN", 9: "WARN", 10: "SKIPPED", 11: "FAIL", 12: "PASS"}


def test_changed_sinks(spark):
    rows = spark.createDataFrame(PAIRS, "id int, before string, after string")
    assert got(rows.select("id", advisory.sink_modified(F.col("before"), F.col("after"), K.SINKS["CWE-89"]).alias("x")).select("id", "x.*")) == want(PAIRS_WANT)


def test_excerpts_slugs_and_keys(spark):
    frame = spark.createDataFrame
    assert got(frame(EXCERPTS, "id int, code string, line int").select("id", X.excerpt(F.col("code"), F.col("line"), 2))) == want(EXCERPT_WANT)
    assert got(frame(SLUGS, "id int, cve string, ghsa string, code string").select("id", X.slug(F.col("cve"), F.col("ghsa"), F.col("code")))) == want(SLUGS_WANT)
    assert got(frame(ISSUES, "issue string").select(X.issue_key(F.col("issue")))) == want(ISSUES_WANT)
    assert got(frame(RECORDED, "id int, code string, pattern string").select("id", X.recorded_line(F.col("code"), F.col("pattern")))) == want(RECORDED_WANT)
    hints = frame(HINTS, "id int, lang string, value string, url string")
    assert got(hints.select("id", X.names_python(F.array(F.struct("lang", "value")), F.array("url")))) == want(HINTS_WANT)


def test_classes_of_ids_rules_and_answers(spark):
    frame = spark.createDataFrame
    assert got(frame(RAW_IDS, "raw string, want string").select("raw", X.normalize_class(F.col("raw")))) == want(RAW_IDS)
    assert got(frame(RULE_IDS, "rule string, want string").select("rule", X.rule_class(F.col("rule")))) == want(RULE_IDS)
    assert got(frame(ANSWERS, "id int, text string").select("id", F.try_element_at(X.parse_response(X.strip_thinking(F.col("text"))), F.lit(1)))) == want(ANSWERS_WANT)
    assert got(frame(SARIF, "id int, tags array<string>").select("id", F.array_join(advisory.sarif_classes(F.col("tags")), "|"))) == want(SARIF_WANT)


def test_advisories_and_reports(spark):
    frame = spark.createDataFrame
    a = advisory.parse(frame(ADVISORIES, "json string"))
    read = a.select("id", advisory.is_python(F.col("affected")), advisory.first_target(F.col("database_specific.cwe_ids")), advisory.cve_alias(F.col("aliases")), F.array_join(advisory.fix_commits(F.col("references"), F.col("affected")), ","))
    assert got(read) == want(ADVISORY_WANT)
    assert got(advisory.scan_findings(frame(SCANS, "json string"))) == want(SCANS_WANT)
    assert got(advisory.sarif_findings(frame(SARIFS, "json string"))) == want(SARIFS_WANT)
    folded = advisory.fold_findings(frame(SCANNED, "sample_id string"), frame(FINDINGS, "path string, rule string"))
    assert got(folded.select("sample_id", F.array_join("predicted", "|"))) == want(FINDINGS_WANT)
    assert got(advisory.diff_pairs(frame(DIFFS, "id int, path string, diff string")).select("id", "code_before", "code_after")) == want(DIFFS_WANT)


def test_lookups(spark):
    frame = spark.createDataFrame
    rows = advisory.first_class(frame(CVES, "id string, cve_id string"), frame(CVE_CLASSES, "cve_id string, ordinal int, cwe string"))
    assert got(rows.select("id", "cwe")) == want(CVE_CLASSES_WANT)
    scores = frame(SCORES, "id int, v31 array<double>, v30 array<double>, v2 array<double>")
    assert got(scores.select("id", advisory.preferred_score(F.col("v31"), F.col("v30"), F.col("v2")))) == want(SCORES_WANT)
    labelled = frame(LABELLED_LINES, "id string, raw_lines array<string>, labels array<int>")
    assert got(tables.line_labels(labelled, {3: "CWE-94", 5: "CWE-89"}).select("id", "cwe")) == want(LABELLED_WANT)
