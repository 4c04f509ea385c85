"""Scans, record codecs, dual writes and counters."""

from quarry.operators import curate, transforms, weights
from quarry.sources import tables


def test_records_keep_what_they_have(spark):
    rows = [("t", "clean", "a", "CWE-89", ["CWE-89", "CWE-22"], "raw\n\"x\"", 7, "1"), ("t", "clean", "b", "safe", None, None, None, None), ("t", "clean", None, "safe", [], None, 1, None)]
    df = spark.createDataFrame(rows, tables.PREDICTION)
    lines = tables.encode_records(df)
    assert all("\n" not in r["line"] for r in lines.collect())
    back = tables.decode_records(lines.unionByName(spark.createDataFrame([("{broken",), ("",), (None,)], "line string"))).collect()
    assert sorted((r["sample_id"], r["predicted"], r["raw_output"], r["latency_ms"]) for r in back) == [("a", ["CWE-89", "CWE-22"], 'raw\n"x"', 7), ("b", [], None, 0)]


def test_scans_leave_out_what_cannot_be_scored(spark):
    rows = [("a", "CWE-89", 5.0), ("b", "", 0.0), ("c", None, None), (None, "safe", 3.0), ("d", "safe", float("nan")), ("e", "x", float("inf")), ("f", "x", -1.0)]
    df = spark.createDataFrame(rows, "id string, cwe string, cvss_score double")
    assert sorted(r["id"] for r in tables.label_scan(df).collect()) == ["a", "d", "e", "f"]
    assert [tuple(r) for r in tables.score_scan(df).collect()] == [("a", 5.0)]
    assert [r["id"] for r in tables.preview(df.filter("id is not null"), ["id"], 2).collect()] == ["a", "b"]


def test_samples_go_to_both_stores(spark, tmp_path):
    df = spark.createDataFrame([("a", "CWE-89", "x = 1"), ("b", "safe", "y")], "id string, cwe string, code_before string")
    tables.write_samples(df, str(tmp_path / "s"))
    table, files = spark.read.parquet(str(tmp_path / "s/table")), spark.read.json(str(tmp_path / "s/files"))
    assert {(r["id"], r["cwe"], r["code_before"], r["_schema_version"]) for r in table.collect()} == {(r["id"], r["cwe"], r["code_before"], r["_schema_version"]) for r in files.collect()} == {("a", "CWE-89", "x = 1", "3.0"), ("b", "safe", "y", "3.0")}


def test_schedules_fill_labels_and_epochs(spark):
    counts = spark.createDataFrame([("CWE-89", 100), ("CWE-79", 1)], "cwe string, n long")
    got = weights.weight_schedule(spark, counts, ["CWE-79", "CWE-94", "CWE-89"], epochs=7, share=0.5).collect()
    assert [(r["cwe"], r["n"]) for r in got if r["phase"] == "uniform"] == [("CWE-79", 1), ("CWE-94", 0), ("CWE-89", 100)]
    assert {(r["phase"], r["first_epoch"], r["n_epochs"]) for r in got} == {("uniform", 0, 4), ("effective_number", 4, 3)}
    late = {r["cwe"]: r["weight"] for r in got if r["phase"] != "uniform"}
    assert late["CWE-94"] == 0 and abs(sum(late.values()) - 3) < 1e-9


def test_totals_count_contents_and_coverage_rows(spark):
    rows = [("a", "h", 5.0, "vector", "high", True), ("b", "h", None, "missing", "low", False), ("c", "", 1.0, "word", "low", False), (None, None, 1.0, "word", "low", True), ("c", None, 2.0, "word", "low", False)]
    got = {(r["what"], r["key"]): r["n"] for r in weights.target_summary(spark.createDataFrame(rows, "id string, content_hash string, score double, score_source string, confidence string, whole boolean")).collect()}
    assert got == {("total", "all"): 2, ("score_coverage", "all"): 3, ("subvector_coverage", "all"): 1, ("score_source", "vector"): 1, ("score_source", "missing"): 1, ("score_source", "word"): 2, ("confidence", "high"): 1, ("confidence", "low"): 3}


def test_axes_hold_keys_of_any_table(spark):
    a, b = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    assert sorted(r["k"] for r in curate.key_axis(a, b, key="k").collect()) == ["x", "y", "z"]
    assert sorted(tuple(r) for r in curate.report_beside({"a": a, "b": b}, "k").collect()) == [("x", 1, 0), ("y", 2, 1), ("z", 0, 1)]


def test_counters_of_twins_add_up(spark):
    rows = [("a", "import yaml\ndef f(x):\n    return yaml.load(x)\n", "CWE-502"), ("b", "def (", "CWE-502"), ("c", "x = 1\n", "CWE-502"), ("d", "x = 1\n", "CWE-1"), ("e", "x = 1\n", "safe")]
    df = spark.createDataFrame([(*r, "r", None) for r in rows], "id string, code string, cwe string, repo string, cve_id string")
    none = spark.createDataFrame([], "parent_sample_id string")
    got = {(r["counter"], r["key"]): r["n"] for r in transforms.twin_counters(transforms.hard_negatives(df, none)).collect()}
    assert got["attempted", "all"] == 4 and got["succeeded", "all"] == got["class", "CWE-502"] == 1 and got["failed", "all"] == 3
    assert sum(n for (c, _), n in got.items() if c == "reason") == 3 and sum(n for (c, _), n in got.items() if c == "rule") == 1
