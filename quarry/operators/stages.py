"""The curation stages as a whole: cleaning, refiltering, filtering by differences, purging, health audit, gated inserts, configuration and exports.

Every stage takes rows with id, cwe, source, path, code and further columns. Parsers run once over a row, in Arrow batches; all else is native, and wide code is never shuffled:
reports are grouped from narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import syntax
from ..functions import text as X
from . import advisory, curate, split


def validate_and_clean(rows: DataFrame) -> DataFrame:
    """Rows with outcome (empty, invalid_syntax, too_short or kept), has_flask_import, and of kept ones the normalised code and the CVE that the code names, if it names one."""
    reason = curate.clean_reason(F.col("code"), F.col("_valid"))
    flagged = rows.withColumn("_valid", syntax.is_valid_python("code")).withColumn("outcome", F.coalesce(reason, F.lit("kept"))).drop("_valid")
    kept = F.col("outcome") == "kept"
    found = F.when(kept, F.coalesce(X.extract_cve(F.col("code")), F.col("cve_id"))).otherwise(F.col("cve_id"))
    return flagged.withColumns({"cve_id": found, "has_flask_import": X.imports_flask(F.col("code")), "code": F.when(kept, X.normalize(F.col("code"))).otherwise(F.col("code"))})


def gated(rows: DataFrame) -> DataFrame:
    """Rows with sink_ok and sink_pattern of the whole gate."""
    return rows.withColumn("_g", syntax.full_gate("code", "cwe", "path")).withColumns({"sink_ok": F.col("_g.ok"), "sink_pattern": F.col("_g.pattern")}).drop("_g")


def refilter(rows: DataFrame) -> DataFrame:
    """Rows with the reason to move them aside: blocked_source or sink_absent; null for those that stay."""
    return gated(rows).withColumn("reason", curate.refilter_reason(F.col("is_hard_negative"), F.col("cwe"), F.col("source"), F.col("sink_ok")))


def write_outcomes(rows: DataFrame, reason: Column, reasons: list[str], path: str) -> DataFrame:
    """Writes rows to path by their outcome, `kept` or the reason to move them aside, and gives the manifest (outcome, n), all in one pass over the rows.

    Counts are observed as the rows are written; reasons names those that are counted each, others count as `other` in the manifest and are written under their own names.
    Kept and quarantined rows are read back from their partitions alone. Outcomes that are written again replace those of an earlier run.
    """
    spark = rows.sparkSession
    seen = Observation()
    outcome = F.col("outcome")
    flagged = rows.withColumn("outcome", F.coalesce(reason, F.lit("kept")))
    names = ["kept", *reasons]
    counted = flagged.observe(seen, F.count(F.lit(1)).alias("n"), *(F.count_if(outcome == r).alias(f"n{i}") for i, r in enumerate(names)))
    counted.write.mode("overwrite").partitionBy("outcome").parquet(path)
    got = [(r, seen.get[f"n{i}"]) for i, r in enumerate(names)]
    return spark.createDataFrame([*got, ("other", seen.get["n"] - sum(n for _, n in got))], "outcome string, n long").filter("n > 0")


def read_outcome(spark: SparkSession, path: str, outcome: str = "kept") -> DataFrame:
    """The rows of one outcome; other partitions are not read."""
    return spark.read.parquet(path).filter(F.col("outcome") == outcome).drop("outcome")


def refilter_report(flagged: DataFrame) -> DataFrame:
    """Counts by class, by source and of all."""
    n = F.count(F.lit(1))
    sets = flagged.select("cwe", "source", "reason").groupingSets([["cwe"], ["source"], []], "cwe", "source")
    return sets.agg(n.alias("n"), F.count("reason").alias("n_rejected"), F.count_if(F.col("reason") == "blocked_source").alias("n_blocked"), F.round(100.0 * F.count("reason") / n, 6).alias("reject_pct"))


def diff_filter(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Positive rows that are neither canonical nor hard negatives, with modified (whether a sink line of their class was changed; null without a pair to judge by), evidence and
    reason: unchanged sinks go, and with strict also rows without a pair."""
    rows = rows.filter((F.coalesce("cwe", F.lit("")) != "") & (F.col("cwe") != "safe") & (F.coalesce("source", F.lit("")) != "canonical") & ~F.coalesce("is_hard_negative", F.lit(False)))
    found = F.lit(None).cast("struct<modified:boolean,evidence:string>")
    for c, patterns in K.SINKS.items():
        found = F.when(F.col("cwe") == c, advisory.sink_modified(F.col("code"), F.col("code_after"), patterns)).otherwise(found)
    rows = rows.withColumn("_m", found).withColumns({"modified": F.col("_m.modified"), "evidence": F.col("_m.evidence")}).drop("_m")
    missing = F.lit("no_code_after_available") if strict else F.lit(None).cast("string")
    return rows.withColumn("reason", F.when(~F.col("modified"), "sink_line_unchanged").when(F.col("modified").isNull(), missing))


def purge(rows: DataFrame, source: str | None = None, dry_run: bool = True, **switches) -> DataFrame:
    """With dry_run all rows and the reason to purge them (null for those that stay), else the rows that stay. Only rows of source are judged, if it is given."""
    reason = curate.purge_reason(F.col("code"), F.col("cwe"), F.col("_valid"), **switches)
    flagged = rows.withColumn("_valid", syntax.is_valid_python("code")).withColumn("reason", reason if source is None else F.when(F.col("source") == source, reason)).drop("_valid")
    return flagged if dry_run else flagged.filter("reason is null").drop("reason")


def health_audit(rows: DataFrame) -> DataFrame:
    """Rows with the structural signals, confident, plausible and has_taint_source of their class, issues and status; safe rows are SKIPPED, rows without code FAIL."""
    code, cwe = F.col("code"), F.col("cwe")
    s = curate.structure(code, F.col("_valid"))
    checks = curate.class_checks(code, cwe, F.col("_possible"))
    read = rows.withColumns({"_valid": syntax.is_valid_python(F.coalesce("code", F.lit(""))), "_possible": curate.SIGNALS.possible(code)})
    out = read.withColumns({**s, **checks, "issues": curate.health_issues(s, checks, cwe)}).drop("_valid", "_possible")
    status = F.when(cwe == "safe", "SKIPPED").when(code.isNull(), "FAIL").otherwise(curate.health_status(F.col("issues")))
    return out.withColumn("status", status)


def class_signal_columns(rows: DataFrame) -> DataFrame:
    """id and a struct of named signals for the check of each class."""
    read = rows.select("id", "cwe", "code", curate.SIGNALS.possible(F.col("code")).alias("_possible"))
    return read.select("id", "cwe", *(F.struct(*(v.alias(k) for k, v in curate.class_signals(F.col("code"), c, F.col("_possible")).items())).alias(K.CLASS_SLUGS[c]) for c in curate.CLASS_SIGNALS))


def health_rollup(audited: DataFrame) -> DataFrame:
    """Counts by status, by class and status, and by source and status."""
    sets = audited.select("status", "cwe", "source").groupingSets([["status"], ["cwe", "status"], ["source", "status"]], "status", "cwe", "source")
    return sets.agg(F.count(F.lit(1)).alias("n"))


def canonical_insert(existing: DataFrame, incoming: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """Incoming rows with action: rejected (no sink of their class), present (their content is there, or an earlier incoming row has it) or inserted. targets: classes that are taken in;
    others are out_of_scope."""
    rows = gated(incoming).withColumn("content_hash", X.code_hash(F.col("code")))
    there = existing.select(X.code_hash(F.col("code")).alias("content_hash")).distinct().withColumn("_there", F.lit(True))
    scope = F.lit(True) if targets is None else F.coalesce(F.col("cwe").isin(targets), F.lit(False))
    rows = rows.withColumn("_fine", scope & F.col("sink_ok")).withColumn("_scope", scope).drop("code")
    rows = curate.keep_first(rows, F.struct("content_hash", "_fine"), ["id"]).withColumnRenamed("kept", "_first")
    # what is there is asked for by the first row of each content alone; the others have keys of their own, which spread them
    rows = rows.withColumn("_asked", F.when(F.col("_first"), F.col("content_hash")).otherwise(F.concat(F.lit("-"), "id"))).join(there.withColumnRenamed("content_hash", "_asked"), "_asked", "left")
    action = F.when(~F.col("_scope"), "out_of_scope").when(~F.col("sink_ok"), "rejected").when(F.col("_there") | ~F.col("_first"), "present").otherwise("inserted")
    return rows.select("id", "cwe", "content_hash", action.alias("action"))


def training_config(rows: DataFrame, beta: float = 0.9999) -> DataFrame:
    """cwe, n, weight of the training rows: effective-number weights with mean 1, counted from split train alone."""
    n = rows.filter("split = 'train'").groupBy("cwe").agg(F.count(F.lit(1)).alias("n"))
    raw = n.withColumn("raw", (1 - F.lit(beta)) / (1 - F.pow(F.lit(beta), "n")))
    return raw.select("cwe", "n", (F.col("raw") * F.count(F.lit(1)).over(Window.partitionBy()) / F.sum("raw").over(Window.partitionBy())).alias("weight"))


def export_triples(rows: DataFrame) -> DataFrame:
    """id, cwe, folder_index, sink_lines, snippet and changed_lines of positive rows with both sides: lines of before that after lacks, sorted, and the lines that a difference without
    context removes and adds, in order. Rows are numbered within a class by id."""
    rows = rows.filter((F.col("cwe") != "safe") & (F.coalesce("code_after", F.lit("")) != ""))
    trimmed = lambda c: F.filter(F.transform(X.lines(F.col(c)), lambda x: F.trim(x)), lambda x: x != "")
    sinks = F.lit(None).cast("array<struct<line:int,text:string>>")
    for c, patterns in K.SINKS.items():
        sinks = F.when(F.col("cwe") == c, X.sink_lines(F.col("code"), patterns)).otherwise(sinks)
    narrow = rows.select("id", "cwe", sinks["line"].alias("sink_lines"), F.array_join(F.array_sort(F.array_except(trimmed("code"), trimmed("code_after"))), "\n").alias("snippet"), syntax.changed_lines_udf("code", "code_after").alias("changed_lines"))
    return split.ordered_rank(narrow, "cwe", "id").withColumnRenamed("r", "folder_index")


def uniqueness(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(key, n_duplicated, n_null): values of each column that should be unique and are not, and rows without one."""
    counts = None
    for k in keys:
        sizes = rows.groupBy(F.col(k).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        one = sizes.agg(F.count_if(F.col("v").isNotNull() & (F.col("n") > 1)).alias("n_duplicated"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_null")).select(F.lit(k).alias("key"), "n_duplicated", "n_null")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def timestamp_tag(at: Column) -> Column:
    """A time as 20250131T235959Z; the time is a parameter, so that runs can be repeated."""
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")
