"""Deduplication, cleaning, gates, purging, relabelling and table maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..functions.prefilter import Catalogue


def keep_first(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Rows with a flag `kept`: the first of each key; of rows that are equal in key and order too, one. Only key and order columns are needed beside the rest of df, so drop wide ones before.

    The first place of each key is a minimum with partial sums, and rows meet it by key and place together, so that a key that half of all rows have is spread over all tasks.
    """
    at = [f"_at{i}" for i in range(len(order))]
    rows = df.withColumns({"_key": key} | {a: F.col(o) for a, o in zip(at, order, strict=True)})
    first = rows.groupBy("_key").agg(F.min(F.struct(*at)).alias("_f")).select(F.col("_key").alias("_k"), *(F.col(f"_f.{a}").alias(f"{a}f") for a in at), F.lit(True).alias("_hit"))
    same = F.row_number().over(Window.partitionBy("_key", *at).orderBy("_key"))
    met = F.col("_key").eqNullSafe(F.col("_k"))
    for a in at:
        met = met & F.col(a).eqNullSafe(F.col(f"{a}f"))
    flagged = rows.withColumn("_n", same).join(first, met, "left").withColumn("kept", F.col("_hit").isNotNull() & (F.col("_n") == 1))
    return flagged.select(*df.columns, "kept")


def dedup_by_hash(samples: DataFrame) -> DataFrame:
    """id, content_hash, kept: texts are hashed where they are read, so that only hashes are shuffled."""
    narrow = samples.select("id", "doc_id", "cwe", X.code_hash(F.col("code")).alias("content_hash"))
    return keep_first(narrow, F.col("content_hash"), ["doc_id"])


def clean_reason(code: Column, valid: Column) -> Column:
    """Why cleaning drops a row, in order; null if it stays."""
    return F.when(~code.rlike(r"\S"), "empty").when(~valid, "invalid_syntax").when(X.code_lines(code) < 5, "too_short")


def refilter_reason(hard_negative: Column, cwe: Column, source: Column, sink_ok: Column) -> Column:
    """Why refiltering drops a row; null if it stays."""
    blocked = F.lit(False)
    for s, c in K.BLOCKED:
        blocked = blocked | ((source == s) & (cwe == c))
    exempt = F.coalesce(hard_negative, F.lit(False)) | cwe.isNull() | cwe.isin("safe", "")
    return F.when(exempt, None).when(blocked, "blocked_source").when(~sink_ok, "sink_absent")


def purge_reason(code: Column, cwe: Column, valid: Column | None = None, no_exec=True, attack=True, false_labels=True, no_flask=False) -> Column:
    """The first reason, in fixed order, to purge a row; null if it stays. Each reason can be switched off."""
    supported = F.lit(True)
    for name, patterns in K.SUPPORT.items():
        supported = F.when(cwe == name, X.any_of(code, patterns)).otherwise(supported)
    server = code.rlike(r"(?i)(from flask|import flask)") | code.rlike(K.TAINT_AUDIT)
    checks = []
    if valid is not None:
        checks.append(F.when(~valid, "invalid Python syntax"))
    if no_exec:
        checks.append(F.when(X.executable_lines(code) <= 2, "no executable code"))
    if attack:
        checks.append(F.when(X.is_attack_script(code), "attack script"))
    if false_labels:
        checks.append(F.when(~supported, F.concat(F.lit("no support for "), cwe)))
    if no_flask:
        checks.append(F.when(~server, "no web import and no request data"))
    return F.coalesce(*checks, F.lit(None).cast("string"))


def structure(code: Column, valid: Column) -> dict[str, Column]:
    """Structural signals of the health audit."""
    return {
        "valid_syntax": valid,
        "has_flask_import": code.rlike(K.AUDIT_FLASK),
        "has_executable_code": X.executable_lines(code) > 2,
        "has_route_handler": code.rlike(K.AUDIT_ROUTE),
        "has_request_taint": code.rlike(K.TAINT_AUDIT),
        "is_likely_attack": sum((code.rlike(p).cast("int") for p in K.AUDIT_ATTACK), F.lit(0)) >= 2,
        "executable_lines": X.executable_lines(code),
    }


#: The signals of each class's check; every class has request data, confident and plausible too.
CLASS_SIGNALS = {
    "CWE-89": ["sql_execute", "sql_inline", "sql_multiline", "sql_orm", "sql_keywords"],
    "CWE-78": ["command_call", "shell_true", "eval_exec"],
    "CWE-22": ["file_operation", "traversal_hint"],
    "CWE-502": ["deserialization", "raw_deserialization", "yaml_load", "safe_yaml"],
    "CWE-79": ["xss_sink"],
    "CWE-94": ["dynamic_exec"],
    "CWE-918": ["http_call"],
}


#: The patterns of all class checks.
SIGNALS = Catalogue([*(p for names in CLASS_SIGNALS.values() for name in names for p in K.AUDIT[name]), K.TAINT_AUDIT])


def class_signals(code: Column, cwe: str, possible: Column | None = None) -> dict[str, Column]:
    """The signals of one class: has_<signal> for each of CLASS_SIGNALS, has_taint_source, confident, plausible.

    A label is confirmed by request data beside a sink of its class (for SQL by an unsafe statement that is run), and plausible with a sink alone.
    possible: a column of SIGNALS.possible(code), by which only patterns that can match are run.
    """
    found = lambda patterns: X.any_of(code, patterns) if possible is None else SIGNALS.matches(code, possible, patterns)
    has = {name: found(K.AUDIT[name]) for name in CLASS_SIGNALS[cwe]}
    taint = found([K.TAINT_AUDIT])
    extra = {}
    if cwe == "CWE-89":
        built = has["sql_inline"] | has["sql_multiline"]
        sure = (has["sql_execute"] & built) | has["sql_orm"] | (has["sql_keywords"] & taint & has["sql_multiline"])
        maybe = has["sql_execute"] | (has["sql_keywords"] & taint)
        extra["has_unsafe_format"] = built | has["sql_orm"]
    elif cwe == "CWE-502":
        extra["has_unsafe_yaml"] = has["yaml_load"] & ~has["safe_yaml"]
        sure, maybe = (has["raw_deserialization"] | extra["has_unsafe_yaml"]) & taint, has["deserialization"]
    else:
        sink = has[CLASS_SIGNALS[cwe][0]]
        sure, maybe = sink & taint, sink | has.get("eval_exec", has.get("traversal_hint", F.lit(False)))
    return {f"has_{k}": v for k, v in has.items()} | extra | {"has_taint_source": taint, "confident": sure, "plausible": maybe}


def class_checks(code: Column, cwe: Column, possible: Column | None = None) -> dict[str, Column]:
    """confident, plausible and has_taint_source of a row by its class; null where the class has no check."""
    out = {name: F.lit(None).cast("boolean") for name in ("confident", "plausible", "has_taint_source")}
    for c in CLASS_SIGNALS:
        found = class_signals(code, c, possible)
        out = {name: F.when(cwe == c, found[name]).otherwise(value) for name, value in out.items()}
    return out


def health_issues(s: dict[str, Column], checks: dict[str, Column], cwe: Column) -> Column:
    """The issues of a row, in order."""
    sure, maybe, taint = checks["confident"], checks["plausible"], checks["has_taint_source"]
    return F.array_compact(
        F.array(
            F.when(~s["valid_syntax"], "invalid Python syntax"),
            F.when(~s["has_executable_code"], "no executable code"),
            F.when(s["is_likely_attack"] & ~s["has_flask_import"], "appears to be an attack script"),
            F.when(~sure & ~maybe, F.concat(F.lit("false label? "), cwe)).when(~sure & maybe, F.concat(F.lit("weak signal for "), cwe)),
            F.when(~taint, "no request data"),
            F.when(cwe.isNull() | (cwe == ""), "no class"),
        )
    )


def health_status(issues: Column) -> Column:
    hard = F.exists(issues, lambda i: i.rlike("invalid|no executable|false label"))
    return F.when(F.size(issues) == 0, "PASS").when(hard, "FAIL").otherwise("WARN")


def latest_per_key(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """An upsert: of each key the row of greatest order; a merge for tables without one."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return existing.unionByName(incoming).withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def apply_assignment(rows: DataFrame, assignment: DataFrame, key: str, column: str, clear: bool) -> DataFrame:
    """Rows with column from the assignment; without one it is kept, or set to null with clear. `changed` tells where it differs."""
    new = assignment.select(key, F.col(column).alias("_new"))
    value = F.col("_new") if clear else F.coalesce("_new", column)
    out = rows.join(new, key, "left").withColumn("_value", value)
    return out.withColumn("changed", ~F.col("_value").eqNullSafe(F.col(column))).withColumn(column, F.col("_value")).drop("_new", "_value")


def relabel(rows: DataFrame, old: str, new: str, note: str) -> DataFrame:
    """Rows of a class moved to another, with a note added to provenance_notes."""
    is_old = F.col("cwe") == old
    notes = F.when(is_old, F.array_append("provenance_notes", F.lit(note))).otherwise(F.col("provenance_notes"))
    return rows.withColumn("provenance_notes", notes).withColumn("cwe", F.when(is_old, new).otherwise(F.col("cwe")))


def mirror_plan(source: DataFrame, mirror: DataFrame, key: str) -> DataFrame:
    """(key, action): delete what the source lacks, insert what the mirror lacks, keep the rest."""
    s, m = source.select(key).distinct().withColumn("_s", F.lit(True)), mirror.select(key).distinct().withColumn("_m", F.lit(True))
    action = F.when(F.col("_s").isNull(), "delete").when(F.col("_m").isNull(), "insert").otherwise("keep")
    return s.join(m, key, "full_outer").select(key, action.alias("action"))


def quarantine(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with reason) of one pass; df should be cached or cut by the caller if both are written."""
    flagged = df.withColumn("reason", reason)
    return flagged.filter("reason is null").drop("reason"), flagged.filter("reason is not null")


def rollback(df: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Rows of sources other than those that begin with prefix, and a manifest of the others."""
    gone = F.startswith(F.col("source"), F.lit(prefix))
    return df.filter(~gone | F.col("source").isNull()), df.filter(gone).groupBy("source", "cwe").agg(F.count(F.lit(1)).alias("n"))


def key_axis(*frames: DataFrame, key: str) -> DataFrame:
    """The values of a key that any of some tables has, once each: the rows of a report that compares them."""
    out = None
    for f in frames:
        own = f.select(key).filter(F.col(key).isNotNull()).distinct()
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def report_beside(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """key and a count for each named table, 0 where it has no row of the key."""
    long = None
    for name, f in frames.items():
        own = f.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(key, F.lit(name).alias("_name"), "n")
        long = own if long is None else long.unionByName(own)
    return long.groupBy(key).pivot("_name", list(frames)).agg(F.sum("n")).na.fill(0, list(frames))


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows of sources whose columns may differ."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
