import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import constants as K
from quarry.operators import curate
from quarry.sources import tables
from quarry.streaming import incremental


def test_sample_folder(spark, tmp_path):
    for stem, meta, code in [("a", {"id": "a", "cwe": "CWE-89", "split": "test"}, "x = 1\n"), ("b", {"id": "b", "cwe": "CWE-79", "code_before": "y = 2"}, None), ("c", {"id": "c", "cwe": ""}, "z"), ("d", None, "q")]:
        (tmp_path / f"{stem}.meta.json").write_text("{broken" if meta is None else json.dumps(meta, indent=1))
        if code:
            (tmp_path / f"{stem}.py").write_text(code)
    rows = {r["id"]: r["code"] for r in tables.read_sample_folder(spark, str(tmp_path)).collect()}
    assert rows == {"a": "x = 1\n", "b": "y = 2"}
    assert [r["id"] for r in tables.read_sample_folder(spark, str(tmp_path), "test").collect()] == ["a"]


def test_canonical_rows(spark):
    r = tables.canonical(spark.createDataFrame([("i", "s", "code", 7)], "id string, source string, code_before string, extra int")).first()
    assert len(r) == 26 and r["label_confidence"] == "medium" and r["framework"] == "unknown" and r["is_hard_negative"] is False and len(r["content_hash"]) == 16 and "extra" not in r.asDict()


def test_one_failing_source_stops_no_other(spark):
    ok = lambda: spark.createDataFrame([("i", "x")], "id string, code_before string")
    rows, messages = tables.ingest({"good": ok, "bad": lambda: 1 / 0, "also": ok}, ["good", "bad", "none", "also"])
    assert rows.count() == 2 and [m.split(":")[0] for m in messages] == ["bad", "none"]


def test_predictions_are_overwritten_by_variant(spark, tmp_path):
    path = str(tmp_path / "p")
    make = lambda v, n: spark.createDataFrame([("t", v, str(i), "safe", ["CWE-89"]) for i in range(n)], "tool string, variant string, sample_id string, ground_truth string, predicted array<string>")
    tables.write_by_variant(make("clean", 3).union(make("composed", 2)), path)
    tables.write_by_variant(make("clean", 1), path)
    got = {r["variant"]: r["count"] for r in spark.read.json(path).groupBy("variant").count().collect()}
    assert got == {"clean": 1, "composed": 2}
    (tmp_path / "x.jsonl").write_text('{"tool":"t","sample_id":"a"}\n\n{"tool":"t","sample_id":"b","predicted":["CWE-1"]}\n')
    assert sorted((r["sample_id"], len(r["predicted"])) for r in tables.read_predictions(spark, str(tmp_path / "x.jsonl")).collect()) == [("a", 0), ("b", 1)]


def test_readers_and_variants(spark):
    none, some = spark.createDataFrame([], "id int"), spark.range(2)
    assert tables.read_first([("a", lambda: none), ("b", lambda: some)])[0] == "b"
    with pytest.raises(ValueError):
        tables.read_first([("a", lambda: none)])
    rows = spark.createDataFrame([("1", "clean"), ("2", "composed")], "id string, variant string")
    safe = spark.createDataFrame([("9",)], "id string")
    assert tables.load_variant(rows, "clean", safe).count() == 2 and tables.load_variant(rows, "composed").count() == 1
    with pytest.raises(ValueError):
        tables.load_variant(rows, "nope")
    labels = spark.createDataFrame([("a", ["x" * 20, "y" * 20], [0, 2]), ("b", ["x"], [2])], "id string, raw_lines array<string>, labels array<int>")
    assert [(r["id"], r["cwe"]) for r in tables.line_labels(labels, {2: "CWE-89"}).collect()] == [("a", "CWE-89")]


def test_mining_and_manifest(spark, tmp_path):
    for n, text in [("a.py", "eval(x)" + " " * 60), ("b.py", "eval(x)" + " " * 60), ("test_c.py", "eval(x)" + " " * 60), ("d.py", "eval(")]:
        (tmp_path / n).write_text(text)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert [r["path"].rsplit("/", 1)[-1] for r in tables.mine_files(files, K.SINKS["CWE-94"], tmp_path.name).collect()] == ["a.py"]
    m = tables.manifest(spark.createDataFrame([("x",), ("x",), ("y",)], "reason string"), run="r1").first()
    assert m["reasons"] == {"x": 2, "y": 1} and m["rejected"] == 3 and m["run"] == "r1"


def test_stream_ingest_is_idempotent(spark, tmp_path):
    src, target, state = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id":"a","code":"x"}\n{"id":"b","code":"x"}\n{"id":"c","code":"y"}\n')
    run = lambda: incremental.stream_ingest(spark, src, "id string, code string", target, state, lambda df: df.filter("code <> 'bad'")).awaitTermination(60)
    run()
    assert spark.read.parquet(target).count() == 2
    (tmp_path / "in" / "2.json").write_text('{"id":"d","code":"y"}\n{"id":"e","code":"z"}\n{"id":"f","code":"bad"}\n')
    run()
    run()
    assert sorted(r["code"] for r in spark.read.parquet(target).collect()) == ["x", "y", "z"]


def test_windows_leave_out_late_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = lambda t: json.dumps({"ts": t, "event_type": "a", "value": 1.0}) + "\n"
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for i, t in enumerate(["2024-01-01T10:00:00", "2024-01-05T10:00:00", "2024-01-06T10:00:00", "2024-01-01T11:00:00", "2024-01-09T10:00:00"]):
        (tmp_path / "in" / f"{i}.json").write_text(line(t))
        import os

        os.utime(tmp_path / "in" / f"{i}.json", (1000 + i, 1000 + i))
    q = incremental.windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("late_rows").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {str(r["window_start"])[:10]: r["n"] for r in spark.table("late_rows").collect()}
    assert got["2024-01-01"] == 1 and got["2024-01-05"] == 1


def test_detector_failures_give_empty_predictions(spark):
    rows = spark.createDataFrame([("clean", "a", "safe", "x"), ("clean", "b", "safe", "y")], "variant string, sample_id string, ground_truth string, code string").coalesce(1)
    ok = incremental.evaluate(rows, lambda xs: {i: {"CWE-89", "CWE-22"} for i, c in xs if c == "y"}, "1").collect()
    assert {r["sample_id"]: r["predicted"] for r in ok} == {"a": [], "b": ["CWE-22", "CWE-89"]}

    def fails(xs):
        raise OSError("no tool")

    assert {r["error"] for r in incremental.evaluate(rows, fails, "1").collect()} == {"OSError: no tool"}


def test_quarantine_splits_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, source string")
    kept, gone = curate.quarantine(df, F.when(F.col("source") == "b", "why"))
    assert [r["id"] for r in kept.collect()] == [1] and [tuple(r) for r in gone.collect()] == [(2, "b", "why")]
