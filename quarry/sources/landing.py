"""Landed inputs and small outputs: pages of web interfaces, advisory trees, configuration files, summaries and lists of known hashes.

Fetching is no part of this; what was fetched lies in files on any path that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, json) of every file below path whose name fits."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("json"))


def read_advisory_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, json) of the JSON advisories of a tree."""
    return _files(spark, path, "*.json")


def read_yaml_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, json) of the YAML advisories of a tree; json is null where a file cannot be parsed. Executors need a YAML reader."""

    @pandas_udf("string")
    def convert(content):
        import json

        import yaml

        def one(text):
            try:
                return json.dumps(yaml.safe_load(text), default=str)
            except yaml.YAMLError:
                return None

        return content.map(one)

    return _files(spark, path, "*.y*ml").select("path", convert("json").alias("json"))


def read_pages(spark: SparkSession, path: str, item: T.StructType | str, per_page: int = 100) -> DataFrame:
    """The items of landed pages page_<number>.json, each a list. The first page that is not full is the last: what lies behind it stems from an earlier run and is left out."""
    kind = item if isinstance(item, str) else item.simpleString()
    pages = _files(spark, path, "page_*.json").select(F.regexp_extract("path", r"page_([0-9]+)\.json$", 1).cast("long").alias("page"), F.from_json("json", f"array<{kind}>").alias("items"))
    short = pages.filter(F.coalesce(F.size("items"), F.lit(0)) < per_page).agg(F.min("page").alias("last"))
    return pages.crossJoin(F.broadcast(short)).filter(F.col("last").isNull() | (F.col("page") <= F.col("last"))).select("page", F.explode("items").alias("item")).select("page", "item.*")


def read_offset_pages(spark: SparkSession, path: str, item: T.StructType | str, field: str = "vulnerabilities") -> tuple[DataFrame, DataFrame]:
    """(items, gaps) of landed answers with startIndex, resultsPerPage, totalResults and a list field. Answers that repeat a start count once; gaps has the starts that are missing."""
    kind = item if isinstance(item, str) else item.simpleString()
    answer = F.from_json("json", f"struct<startIndex:long,resultsPerPage:long,totalResults:long,`{field}`:array<{kind}>>")
    answers = _files(spark, path, "*.json").select("path", answer.alias("a")).filter("a.startIndex is not null")
    first = Window.partitionBy("start").orderBy("path")
    once = answers.select("path", F.col("a.startIndex").alias("start"), F.col("a.resultsPerPage").alias("size"), F.col("a.totalResults").alias("total"), F.col(f"a.`{field}`").alias("items"))
    once = once.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")
    needed = once.agg(F.max("size").alias("size"), F.max("total").alias("total")).filter("total > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.col("size"))).alias("start"))
    return once.select("start", F.explode("items").alias("item")).select("start", "item.*"), needed.join(once.select("start"), "start", "left_anti")


def read_package_answers(spark: SparkSession, answers: str, details: str) -> DataFrame:
    """(package, id, json): the details that each package's landed answer <package>.json ({"vulns": [{"id"}]}) names; json is null where the detail file <id>.json is missing."""
    asked = _files(spark, answers, "*.json").select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("package"), F.explode(F.from_json("json", "struct<vulns:array<struct<id:string>>>")["vulns"]).alias("v"))
    found = _files(spark, details, "*.json").select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("id"), "json")
    return asked.select("package", F.col("v.id").alias("id")).distinct().join(found, "id", "left").select("package", "id", "json")


def read_config(spark: SparkSession, path: str, schema: T.StructType | str) -> dict:
    """A configuration file as a dictionary; fields that the schema has and the file lacks are None."""
    row = spark.read.schema(schema).option("multiLine", True).json(path).first()
    if row is None:
        raise ValueError(f"{path} is empty")
    return row.asDict(recursive=True)


def write_summary(summary: DataFrame, path: str) -> None:
    """A summary, which is a few rows, as one JSON file."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def write_seen(hashes: DataFrame, path: str) -> None:
    """The distinct hashes in order, as text."""
    hashes.select(F.col(hashes.columns[0]).cast("string").alias("value")).filter("value is not null").distinct().sort("value").write.mode("overwrite").text(path)


def read_seen(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("content_hash"))
