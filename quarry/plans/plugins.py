"""Queries over syntax-tree plug-ins and parsers, which no SQL can state; tests hold them against contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import syntax
from ..functions import text as X
from ..operators import transforms
from ..sources import relations as R
from ..sources import snippets as C
from .curation import code_rows
from .registry import query


WITH = "WITH " + C.SNIPPETS_SQL


def _programs(spark, d):
    return code_rows(spark, d).select("id", "doc_id", "code", "code_after", "cwe", "path", F.lit("r").alias("repo"), "cve_id", (F.col("cwe") == "safe").alias("is_hard_negative"))


@query()
def mutate_variants(spark, d):
    return transforms.build_variants(_programs(spark, d)).select("id", "variant", "variant_code", F.array_join("applied", "|").alias("applied"))


@query()
def variant_rates(spark, d):
    return transforms.success_rates(transforms.build_variants(_programs(spark, d)))


@query()
def epoch_augment(spark, d):
    return transforms.augment(_programs(spark, d), F.lit(3), holdout=("taint_through_dict",)).select("id", "variant_code", F.array_join("applied", "|").alias("applied"))


@query()
def sanitize_hardneg(spark, d):
    rows = _programs(spark, d)
    return transforms.hard_negatives(rows, rows.filter("doc_id % 10 = 0").select(F.col("id").alias("parent_sample_id")))


@query()
def changed_lines(spark, d):
    return _programs(spark, d).select("id", F.explode(syntax.changed_lines_udf("code", "code_after")).alias("x")).select("id", "x.op", "x.text")


@query()
def calls(spark, d):
    """Every call of every program, by a table function."""
    from uuid import uuid4

    name = f"quarry_{uuid4().hex}"
    spark.udtf.register(name, syntax.calls_table())
    _programs(spark, d).select("id", "code").createOrReplaceTempView(f"{name}_rows")
    return spark.sql(f"SELECT s.id, c.call, c.line FROM {name}_rows s, LATERAL {name}(s.code) c")


@query(f"""{WITH} SELECT id, shape = 3 AS has_os, shape = 0 AS has_request, shape IN (6, 7, 11) AS has_parser, CASE WHEN shape IN (0, 3, 6, 7, 11) THEN 1 ELSE 0 END AS n_imports FROM v_snippets""")
def import_signals(spark, d):
    """What each program imports: a module, a name of one, and one of several modules."""
    read = _programs(spark, d).select("id", syntax.imports_udf("code").alias("x"))
    x = F.col("x")
    parser = X.has_import(x, "pickle") | X.has_import(x, "requests") | X.has_import(x, "yaml", "yaml")
    return read.select("id", X.has_import(x, "os").alias("has_os"), X.has_from_import(x, "flask", "request").alias("has_request"), parser.alias("has_parser"), F.size(x).alias("n_imports"))


@query()
def sink_calls(spark, d):
    """How many calls of a function by its whole name, and by its last part, each program has."""
    from uuid import uuid4

    name = f"quarry_{uuid4().hex}"
    spark.udtf.register(name, syntax.calls_table())
    _programs(spark, d).select("id", "code").createOrReplaceTempView(f"{name}_rows")
    found = spark.sql(f"SELECT s.id, c.call FROM {name}_rows s, LATERAL {name}(s.code) c")
    one = lambda target, out: F.count_if(X.call_matches(F.col("call"), target)).alias(out)
    return found.groupBy("id").agg(one("pickle.loads", "n_pickle_loads"), one("loads", "n_loads"), one("execute", "n_execute"), F.count(F.lit(1)).alias("n"))


@query(r"SELECT doc_id, sha256(regexp_replace(text, '[^\n]', ' ', 'g')) AS blank_sha, length(text) - length(replace(text, chr(10), '')) AS n_newlines FROM documents")
def blanked_texts(spark, d):
    """Every text as blanks with the same lines."""
    blank = X.blank_keep_newlines(F.col("text"))
    return R.read(spark, d, "documents").select("doc_id", F.sha2(blank, 256).alias("blank_sha"), F.regexp_count(blank, F.lit("\n")).cast("long").alias("n_newlines"))


@query()
def locate_sink(spark, d):
    """The line of a recorded pattern, or of the first one of the class's catalogue."""
    found = syntax.locate_udf("code", "cwe", F.when(F.col("doc_id") % 3 == 0, "execute").when(F.col("doc_id") % 7 == 0, "(broken"))
    return _programs(spark, d).select("id", found.alias("x")).select("id", "x.line", "x.pattern")


@query()
def redact_credentials(spark, d):
    secret = F.concat(F.lit("import re\nDB_PASSWORD = 'Abc"), F.col("doc_id").cast("string"), F.lit("!long'\n"), F.col("code"))
    return _programs(spark, d).select("id", syntax.redact_udf(F.when(F.col("doc_id") % 2 == 0, secret).otherwise(F.col("code"))).alias("code"))
