"""Readers and writers: sample folders, prediction logs, advisory trees, upserts, resumable outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.text import code_hash

STRING, BOOL, DOUBLE = T.StringType(), T.BooleanType(), T.DoubleType()

#: The canonical row of the corpus, version 3.0; missing values of these columns have a default.
SAMPLE = T.StructType(
    [
        T.StructField(n, t)
        for n, t in [
            ("_schema_version", STRING), ("id", STRING), ("source", STRING), ("cve_id", STRING), ("ghsa_id", STRING), ("cwe", STRING),
            ("label_source", STRING), ("label_confidence", STRING), ("cvss_score", DOUBLE), ("cvss_severity", STRING), ("cvss_version", STRING),
            ("cvss_vector", STRING), ("repo", STRING), ("file_path", STRING), ("fix_commit", STRING), ("code_before", STRING), ("code_after", STRING),
            ("framework", STRING), ("sink_pattern", STRING), ("content_hash", STRING), ("pair_id", STRING), ("nvd_enriched", BOOL), ("split", STRING),
            ("is_hard_negative", BOOL), ("parent_sample_id", STRING), ("sanitization_transform", STRING),
        ]
    ]
)
DEFAULTS = {"_schema_version": "3.0", "cwe": "", "label_source": "advisory", "label_confidence": "medium", "code_after": "", "framework": "unknown", "nvd_enriched": False, "is_hard_negative": False}
PREDICTION = T.StructType().add("tool", STRING).add("variant", STRING).add("sample_id", STRING).add("ground_truth", STRING).add("predicted", T.ArrayType(STRING)).add("raw_output", STRING).add("latency_ms", T.IntegerType()).add("tool_version", STRING)


def canonical(df: DataFrame) -> DataFrame:
    """All 26 columns with defaults; columns outside the schema are left out, the content hash is computed."""
    have = {c.lower() for c in df.columns}
    cols = {f.name: (F.col(f.name).cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)) for f in SAMPLE}
    for name, value in DEFAULTS.items():
        cols[name] = F.coalesce(cols[name], F.lit(value))
    cols["_schema_version"], cols["content_hash"] = F.lit("3.0"), code_hash(cols["code_before"])
    return df.select(*(c.alias(n) for n, c in cols.items()))


def read_sample_folder(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Rows of <stem>.meta.json files with the code of <stem>.py beside them, or code_before where there is no such file. Files that cannot be
    parsed, and rows without code or class, are left out. Works on any path that Spark reads."""
    meta = spark.read.schema(T.StructType([*SAMPLE.fields, T.StructField("_corrupt_record", STRING)])).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").json(path)
    stem = lambda suffix: F.regexp_replace(F.input_file_name(), suffix, "")
    meta = meta.withColumn("_stem", stem(r"\.meta\.json$")).filter("_corrupt_record is null").drop("_corrupt_record")
    if split is not None:
        meta = meta.filter(F.col("split") == split)
    code = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").text(path, wholetext=True).select(stem(r"\.py$").alias("_stem"), F.col("value").alias("_code"))
    rows = meta.join(code, "_stem", "left").withColumn("code", F.coalesce("_code", "code_before")).drop("_stem", "_code")
    return rows.filter((F.coalesce("code", F.lit("")) != "") & (F.coalesce("cwe", F.lit("")) != ""))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction records of JSON lines; blank lines are skipped, a missing prediction list is empty."""
    rows = spark.read.schema(PREDICTION).json(path)
    return rows.filter("sample_id is not null").withColumn("predicted", F.coalesce("predicted", F.array().cast("array<string>")))


def present(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have a value, not null and not empty, in each of the columns."""
    return rows.filter(" and ".join(f"`{c}` is not null and `{c}` <> ''" for c in columns)) if columns else rows


def split_inputs(rows: DataFrame) -> DataFrame:
    """What a split needs of rows with an id; rows that do not say so are no hard negatives."""
    rows = rows.filter("id is not null and id <> ''")
    return rows.select("id", "cwe", "repo", "framework", "source", F.coalesce("is_hard_negative", F.lit(False)).alias("is_hard_negative"), "parent_sample_id")


def config_inputs(rows: DataFrame) -> DataFrame:
    """What class weights and severity targets need of rows with an id."""
    return rows.filter("id is not null and id <> ''").select("id", "content_hash", "cwe", "split", "cvss_score", "cvss_severity", "cvss_vector", "label_confidence")


def label_scan(rows: DataFrame) -> DataFrame:
    """id, cwe of rows that have both: the true labels that predictions are held against."""
    return present(rows, ["id", "cwe"]).select("id", "cwe")


def score_scan(rows: DataFrame) -> DataFrame:
    """id, score of rows whose score is a finite number above 0."""
    score = F.col("cvss_score").try_cast("double")
    return rows.select("id", score.alias("score")).filter("id is not null and score > 0 and score < double('infinity')")


def preview(rows: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """The first n rows in an order, for a report: each task keeps n rows at most."""
    return rows.orderBy(*order).limit(n)


def encode_records(records: DataFrame) -> DataFrame:
    """(line): each prediction record as a line of JSON; fields without a value are left out."""
    return records.select(F.to_json(F.struct(*(F.col(f.name) if f.name in records.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in PREDICTION.fields))).alias("line"))


def decode_records(lines: DataFrame) -> DataFrame:
    """Prediction records of lines (line) of JSON: a missing list of classes is empty, a missing latency 0; lines without a sample, or that cannot be parsed, are left out."""
    r = lines.select(F.from_json("line", PREDICTION).alias("r")).select("r.*").filter("sample_id is not null")
    return r.withColumns({"predicted": F.coalesce("predicted", F.array().cast("array<string>")), "latency_ms": F.coalesce("latency_ms", F.lit(0))})


def write_samples(samples: DataFrame, path: str) -> None:
    """Rows to both stores: the table under table/, and under files/ a line of JSON for each row, its metadata beside its code, in a folder for each class."""
    rows = canonical(samples)
    rows.write.mode("overwrite").parquet(f"{path}/table")
    rows.write.mode("overwrite").partitionBy("cwe").json(f"{path}/files")


def read_first(readers: list[tuple[str, Callable[[], DataFrame]]]) -> tuple[str, DataFrame]:
    """The first source that has rows, with its name."""
    for name, read in readers:
        df = read()
        if not df.isEmpty():
            return name, df
    raise ValueError("no source has rows")


def ingest(sources: dict[str, Callable[[], DataFrame]], names: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The union of canonical rows of the named sources, and messages about those that are unknown or fail; one failure stops no other."""
    out, messages = None, []
    for name in names or list(sources):
        if name not in sources:
            messages.append(f"{name}: unknown source")
            continue
        try:
            rows = canonical(sources[name]())
        except Exception as e:
            messages.append(f"{name}: {type(e).__name__}: {e}")
            continue
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("; ".join(messages) or "no sources")
    return out, messages


def line_labels(rows: DataFrame, classes: dict[int, str]) -> DataFrame:
    """id, code, cwe of rows with raw_lines and a label per line: the greatest label decides; texts of under 30 characters are left out."""
    at = F.create_map(*(F.lit(x) for kv in classes.items() for x in kv))
    code = F.trim(F.array_join("raw_lines", ""))
    return rows.select("id", code.alias("code"), F.try_element_at(at, F.array_max("labels")).alias("cwe")).filter((F.length("code") >= 30) & F.col("cwe").isNotNull())


def mine_files(files: DataFrame, patterns: list[str], root: str = "", most: int = 100_000, least: int = 50) -> DataFrame:
    """path, code of binaryFile rows that are small, are no tests (by the path below root), hold a pattern, and are the first with their content."""
    from ..functions import text as X
    from ..operators.curate import keep_first

    code = F.decode("content", "UTF-8")
    small = files.filter((F.col("length") <= most) & F.endswith("path", F.lit(".py")) & ~X.is_test_path(F.substring_index("path", root, -1) if root else F.col("path"))).select("path", code.alias("code"))
    hit = small.filter((F.length("code") >= least) & X.any_of(F.col("code"), patterns))
    first = keep_first(hit.select("path", code_hash(F.col("code")).alias("h")), F.col("h"), ["path"]).filter("kept").select("path")
    return hit.join(first, "path", "left_semi")


def write_by_variant(records: DataFrame, path: str) -> None:
    """Overwrites only the tool and variant partitions that records have, so that a finished variant is a checkpoint."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tool", "variant").json(path)


def write_export(triples: DataFrame, path: str) -> None:
    triples.write.mode("overwrite").partitionBy("cwe").json(path)


def manifest(rejected: DataFrame, **parameters) -> DataFrame:
    """One row: parameters and how many rows were rejected for each reason."""
    reasons = rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("reasons"))
    return reasons.select(*(F.lit(v).alias(k) for k, v in parameters.items()), "reasons", F.aggregate(F.map_values("reasons"), F.lit(0).cast("long"), lambda a, b: a + b).alias("rejected"))


def safe_negatives(samples: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """Test rows that are safe or hard negatives, without the excluded ids."""
    return samples.filter((F.col("split") == "test") & ((F.col("cwe") == "safe") | F.col("is_hard_negative")) & ~F.col("id").isin(*excluded, ""))


def load_variant(positives: DataFrame, variant: str, safe: DataFrame | None = None) -> DataFrame:
    """Rows of one variant; clean comes with the safe rows."""
    if variant not in K.VARIANTS:
        raise ValueError(f"unknown variant {variant}")
    rows = positives.filter(F.col("variant") == variant)
    return rows.unionByName(safe.withColumn("variant", F.lit("clean")), allowMissingColumns=True) if variant == "clean" and safe is not None else rows
