"""Advisory documents, scanner findings and model answers as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X

ADVISORY = """id string, aliases array<string>, severity array<struct<type:string,score:string>>, references array<struct<url:string>>,
affected array<struct<package:struct<name:string,ecosystem:string>,ranges:array<struct<type:string,repo:string,events:array<struct<introduced:string,fixed:string>>>>>>,
database_specific struct<cwe_ids:array<string>,severity:string>"""
COMMIT = r"github\.com/([^/\s]+/[^/\s]+)/commit/([0-9a-fA-F]{7,40})"


def parse(json: DataFrame) -> DataFrame:
    """Advisories of JSON strings (column json); what cannot be parsed has null fields."""
    return json.select(F.from_json("json", ADVISORY, {"mode": "PERMISSIVE"}).alias("a")).select("a.*")


def is_python(affected: Column) -> Column:
    return F.coalesce(F.exists(affected, lambda a: F.lower(a.package.ecosystem) == "pypi"), F.lit(False))


def first_target(ids: Column) -> Column:
    return F.try_element_at(F.filter(ids, lambda x: x.isin(K.TARGETS)), F.lit(1))


def cve_alias(aliases: Column) -> Column:
    return F.try_element_at(F.filter(aliases, lambda x: F.startswith(x, F.lit("CVE-"))), F.lit(1))


def fix_commits(references: Column, affected: Column) -> Column:
    """array<'repo@sha'>: commits that references name, then fixed events of Git ranges, each once in order."""
    named = F.transform(F.filter(references, lambda r: r.url.rlike(COMMIT)), lambda r: F.concat(F.regexp_extract(r.url, COMMIT, 1), F.lit("@"), F.regexp_extract(r.url, COMMIT, 2)))
    git = F.filter(F.flatten(F.transform(affected, lambda a: a.ranges)), lambda r: r.type == "GIT")
    repo = lambda r: F.regexp_replace(F.regexp_extract(r.repo, r"github\.com/([^/\s]+/[^/\s]+)", 1), r"\.git$", "")
    fixed = F.flatten(F.transform(git, lambda r: F.transform(F.filter(r.events, lambda e: F.length(e.fixed) >= 7), lambda e: F.concat(repo(r), F.lit("@"), e.fixed))))
    return F.array_distinct(F.concat(F.coalesce(named, F.array()), F.coalesce(fixed, F.array())))


def preferred_score(v31: Column, v30: Column, v2: Column) -> Column:
    """The first score of the newest version that has one."""
    return F.coalesce(F.try_element_at(v31, F.lit(1)), F.try_element_at(v30, F.lit(1)), F.try_element_at(v2, F.lit(1)))


def sarif_classes(tags: Column) -> Column:
    """Target classes of a rule's tags such as external/cwe/cwe-089, sorted."""
    numbers = F.transform(F.filter(tags, lambda t: t.rlike(r"^external/cwe/cwe-[0-9]+$")), lambda t: F.regexp_replace(F.regexp_extract(t, r"([0-9]+)$", 1), "^0+", ""))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(numbers, X.fold))))


def rule_classes(properties: Column) -> Column:
    """Target classes of a rule's properties: of its tags, and of its list of classes (CWE-78, cwe-78 or 78)."""
    none = F.array().cast("array<string>")
    listed = F.array_compact(F.transform(F.coalesce(properties["cwe"], none), X.normalize_class))
    return F.array_union(sarif_classes(F.coalesce(properties["tags"], none)), listed)


def fold_findings(samples: DataFrame, findings: DataFrame) -> DataFrame:
    """sample_id, predicted: sorted classes of each sample's findings (path, rule); a sample without findings has none."""
    stem = F.regexp_extract("path", r"([^/\\]+?)(\.py)?$", 1)
    named = findings.select(stem.alias("sample_id"), X.rule_class(F.col("rule")).alias("cwe")).filter("cwe is not null")
    sets = named.groupBy("sample_id").agg(F.array_sort(F.collect_set("cwe")).alias("predicted"))
    return samples.select("sample_id").join(sets, "sample_id", "left").withColumn("predicted", F.coalesce("predicted", F.array().cast("array<string>")))


def diff_pairs(diffs: DataFrame) -> DataFrame:
    """id, code_before, code_after of unified diffs: context and removed lines, context and added lines; only where they differ."""
    body = F.filter(X.lines(F.col("diff")), lambda x: ~x.rlike(r"^(---|\+\+\+|@@|diff |index )"))
    side = lambda sign: F.array_join(F.transform(F.filter(body, lambda x: F.substring(x, 1, 1).isin(" ", sign)), lambda x: F.substring(x, 2, 1 << 30)), "\n")
    out = diffs.select("id", "path", side("-").alias("code_before"), side("+").alias("code_after"))
    return out.filter(F.endswith("path", F.lit(".py")) & ~X.is_test_path(F.col("path")) & (F.col("code_before") != F.col("code_after")))


def sink_modified(before: Column, after: Column, patterns: list[str]) -> Column:
    """struct<modified, evidence>: whether a sink line of before is missing after, white space aside; null if there is nothing to judge by. The least such line is the evidence."""
    sinks = lambda c: F.array_distinct(F.transform(F.filter(X.lines(c), lambda x: X.any_of(x, patterns)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))))
    gone = F.array_except(sinks(before), sinks(after))
    judged = (F.coalesce(after, F.lit("")) != "") & (F.size(sinks(before)) > 0)
    return F.struct(F.when(judged, F.size(gone) > 0).alias("modified"), F.when(judged, F.array_min(gone)).alias("evidence"))


def proximity(lines: DataFrame, window: int) -> DataFrame:
    """Adds near: whether any line within window lines in the same text has flag. lines: id, line, flag."""
    from pyspark.sql import Window

    around = Window.partitionBy("id").orderBy("line").rowsBetween(-window, window)
    return lines.withColumn("near", F.max(F.col("flag").cast("int")).over(around) == 1)


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


SCAN_REPORT = "results array<struct<filename:string,test_id:string,line_number:int>>"
SARIF_REPORT = """runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string,properties:struct<tags:array<string>,cwe:array<string>>>>>>,
results:array<struct<ruleId:string,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>>>>>>>"""


def scan_findings(reports: DataFrame) -> DataFrame:
    """path, rule of each finding of scanner reports (column json)."""
    return reports.select(F.explode(F.from_json("json", SCAN_REPORT)["results"]).alias("r")).select(F.col("r.filename").alias("path"), F.col("r.test_id").alias("rule"))


def sarif_findings(reports: DataFrame) -> DataFrame:
    """path, cwe of each result of SARIF reports (column json): target classes of its rule's tags and class list."""
    run = reports.select(F.explode(F.from_json("json", SARIF_REPORT)["runs"]).alias("run"), F.monotonically_increasing_id().alias("report"))
    rule = run.select("report", F.explode("run.tool.driver.rules").alias("r")).select("report", F.col("r.id").alias("rule"), rule_classes(F.col("r.properties")).alias("classes"))
    result = run.select("report", F.explode("run.results").alias("x")).select("report", F.col("x.ruleId").alias("rule"), F.explode("x.locations").alias("at"))
    return result.join(rule, ["report", "rule"]).select(F.col("at.physicalLocation.artifactLocation.uri").alias("path"), F.explode("classes").alias("cwe")).distinct()


def first_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows (cve_id, ...) with cwe: the target class of least ordinal that classes (cve_id, ordinal, cwe) has for the advisory; null without one."""
    fit = classes.filter(F.col("cwe").isin(K.TARGETS)).groupBy("cve_id").agg(F.min_by("cwe", "ordinal").alias("cwe"))
    return rows.join(fit, "cve_id", "left")


def fixed_files(files: DataFrame, commits: DataFrame, fixes: DataFrame, classes: DataFrame, targets: list[str]) -> DataFrame:
    """hash, filename, cve_id, cwe_id, once each: Python files with code before a fix of a target class. files: hash, filename, code_before; commits: hash; fixes: hash, cve_id; classes: cve_id, cwe_id."""
    wanted = files.filter(F.endswith("filename", F.lit(".py")) & F.col("code_before").isNotNull()).select("hash", "filename")
    return wanted.join(commits.select("hash"), "hash").join(fixes.select("hash", "cve_id"), "hash").join(classes.filter(F.col("cwe_id").isin(targets)).select("cve_id", "cwe_id"), "cve_id").distinct()


def audit_pages(rows: DataFrame) -> DataFrame:
    """cwe, page: Markdown of the audited rows (id, cwe, source, line, pattern, excerpt) of each class, by id."""
    entry = F.format_string("### %s\n\n- source: %s\n- line: %s\n- pattern: `%s`\n\n```python\n%s\n```\n\n- [ ] label is right\n", "id", F.coalesce("source", F.lit("unknown")), F.coalesce(F.col("line").cast("string"), F.lit("none")), F.coalesce("pattern", F.lit("none")), F.coalesce("excerpt", F.lit("")))
    parts = rows.groupBy("cwe").agg(F.array_sort(F.collect_list(F.struct("id", entry.alias("text")))).alias("x"))
    return parts.select("cwe", F.concat(F.lit("## "), "cwe", F.lit("\n\n"), F.array_join(F.transform("x", lambda r: r.text), "\n")).alias("page"))
