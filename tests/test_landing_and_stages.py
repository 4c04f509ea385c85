import json

import pytest

from quarry.functions import syntax
from quarry.operators import detectors, stages
from quarry.sources import landing

ITEM = "struct<id:string,n:int>"


def put(folder, name, value):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value))


def test_pages_end_with_the_first_short_one(spark, tmp_path):
    page = lambda a, n: [{"id": f"x{i}", "n": i} for i in range(a, a + n)]
    for number, items in ((1, page(0, 3)), (2, page(3, 3)), (3, page(6, 1)), (4, page(90, 3))):
        put(tmp_path / "p", f"page_{number}.json", items)
    assert sorted(r["id"] for r in landing.read_pages(spark, str(tmp_path / "p"), ITEM, 3).collect()) == [f"x{i}" for i in range(7)]


def test_offset_pages_tell_their_gaps(spark, tmp_path):
    for name, start in (("a", 0), ("b", 4), ("again", 4)):
        put(tmp_path / "o", f"{name}.json", {"startIndex": start, "resultsPerPage": 2, "totalResults": 7, "vulnerabilities": [{"id": f"v{start}", "n": 1}, {"id": f"v{start + 1}", "n": 2}]})
    put(tmp_path / "o", "broken.json", "{")
    items, gaps = landing.read_offset_pages(spark, str(tmp_path / "o"), ITEM)
    assert sorted(r["id"] for r in items.collect()) == ["v0", "v1", "v4", "v5"] and sorted(r["start"] for r in gaps.collect()) == [2, 6]


def test_package_answers_meet_their_details(spark, tmp_path):
    put(tmp_path / "q", "flask.json", {"vulns": [{"id": "A"}, {"id": "B"}, {"id": "A"}]})
    put(tmp_path / "q", "none.json", {})
    put(tmp_path / "d", "A.json", {"id": "A"})
    got = {(r["package"], r["id"]): r["json"] for r in landing.read_package_answers(spark, str(tmp_path / "q"), str(tmp_path / "d")).collect()}
    assert got == {("flask", "A"): '{"id": "A"}', ("flask", "B"): None}


def test_trees_and_configuration(spark, tmp_path):
    put(tmp_path / "t/a/b", "one.json", {"id": 1})
    put(tmp_path / "t/a", "two.yaml", "id: 2\nrefs: [x, y]\n")
    put(tmp_path / "t", "bad.yml", "a: [")
    assert [r["json"] for r in landing.read_advisory_tree(spark, str(tmp_path / "t")).collect()] == ['{"id": 1}']
    pytest.importorskip("yaml")
    assert sorted(str(r["json"]) for r in landing.read_yaml_tree(spark, str(tmp_path / "t")).collect()) == ["None", '{"id": 2, "refs": ["x", "y"]}']
    put(tmp_path, "config.json", {"beta": 0.5, "weights": {"a": 1.0}})
    assert landing.read_config(spark, str(tmp_path / "config.json"), "beta double, weights map<string,double>, extra int") == {"beta": 0.5, "weights": {"a": 1.0}, "extra": None}


def test_summary_and_seen_hashes_are_read_back(spark, tmp_path):
    landing.write_seen(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "h string"), str(tmp_path / "seen"))
    assert [r[0] for r in landing.read_seen(spark, str(tmp_path / "seen")).collect()] == ["a", "b"]
    landing.write_summary(spark.createDataFrame([("t", 0.5)], "tool string, f1 double"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).collect()[0]["f1"] == 0.5 and len(list((tmp_path / "s").glob("part-*"))) == 1


ROW = "id string, cwe string, source string, path string, code string, code_after string, is_hard_negative boolean, cve_id string"


def test_stages_take_nulls_and_no_rows(spark):
    odd = spark.createDataFrame([(None,) * 8, ("a", "CWE-89", None, None, "", None, None, None), ("b", None, "vudenc", "x.py", "x = 1\n", "", True, "C")], ROW)
    for rows, n in ((odd, 3), (spark.createDataFrame([], ROW), 0)):
        assert stages.validate_and_clean(rows).count() == n and stages.refilter(rows).count() == n and stages.purge(rows).count() == n and stages.health_audit(rows).count() == n
        assert stages.class_signal_columns(rows).count() == n and stages.diff_filter(rows).count() <= n and stages.canonical_insert(rows, rows).count() == n
        assert stages.export_triples(rows).count() == 0 and len(stages.uniqueness(rows, ["id", "cve_id"]).collect()) == 2


def test_credentials_are_read_from_the_environment():
    assert syntax.redact('import re\nDB_PASSWORD = "Abc123!long"\n') == "import re\nimport os\nDB_PASSWORD = os.environ['PASSWORD']"
    assert syntax.redact("aws_secret_key='abcdefgh'") == "import os\naws_secret_key=os.environ['SECRET']"
    assert syntax.redact("import os\napi-key = 'abcdefgh'\n") == "import os\napi-key = os.environ['SECRET']\n"
    assert syntax.redact("password = 'a b c d'") == "import os\npassword = os.environ['PASSWORD']" and syntax.redact("x = 1") == "x = 1" and syntax.redact(None) is None


def test_unknown_detectors_and_broken_reports(spark):
    samples = spark.createDataFrame([("a", "CWE-89"), ("b", "safe")], "sample_id string, ground_truth string")
    reports = spark.createDataFrame([("a", "{broken"), ("a", '{"results": [{"test_id": "B608"}, {"test_id": "B608"}]}'), ("a", None)], "sample_id string, report string")
    got = {r["sample_id"]: r["predicted"] for r in detectors.records(samples, reports, "rules", "1").collect()}
    assert got == {"a": ["CWE-89"], "b": []}
    with pytest.raises(ValueError):
        detectors.records(samples, reports, "other", "1")


def test_exports_are_read_back(spark, tmp_path):
    from quarry.sources import tables

    rows = [(f"r{i}", "CWE-94" if i % 2 else "CWE-89", "s", "a.py", f"x = eval(a)\ny = {i}\n", f"x = int(a)\ny = {i}\n", False, None) for i in range(6)]
    triples = stages.export_triples(spark.createDataFrame(rows, ROW))
    tables.write_export(triples, str(tmp_path / "out"))
    back = {(r["cwe"], r["folder_index"]): (r["id"], r["snippet"], r["sink_lines"]) for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert back["CWE-94", 1] == ("r1", "x = eval(a)", [1]) and back["CWE-89", 3] == ("r4", "x = eval(a)", []) and len(back) == 6


def test_projected_inputs(spark):
    from quarry.sources import tables

    rows = tables.canonical(spark.createDataFrame([("a", "CWE-89", "x = 1"), ("", "CWE-89", "x"), (None, None, None)], "id string, cwe string, code_before string"))
    assert [r["id"] for r in tables.split_inputs(rows).collect()] == ["a"] and tables.config_inputs(rows).count() == 1
    assert tables.present(rows, ["id", "cwe"]).count() == 1 and tables.present(rows, []).count() == 3


def test_sampled_rows_follow_their_weights(spark):
    from quarry.operators import weights

    rows = [(f"i{n}", float(n % 3)) for n in range(300)] + [("heavy", 600.0), ("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "id string, weight double")
    got = {r["id"]: r["times"] for r in weights.draws_with_replacement(df, 6000, 5).collect()}
    assert sum(got.values()) == 6000 and "none" not in got and not any(k and k != "heavy" and int(k[1:]) % 3 == 0 for k in got)
    assert abs(got["heavy"] - 6000 * 600 / 900) < 150
    assert got == {r["id"]: r["times"] for r in weights.draws_with_replacement(df.repartition(7), 6000, 5).collect()}
    assert weights.draws_with_replacement(df.limit(0), 10, 1).collect() == [] and weights.draws_with_replacement(df, 0, 1).collect() == []


def test_training_examples_without_targets(spark):
    import math

    from quarry.operators import weights

    rows = spark.createDataFrame([("a", "CWE-502", None, None), ("b", "other", "h", True)], "id string, cwe string, content_hash string, is_hard_negative boolean")
    letters = "AV string, AC string, PR string, UI string, S string, C string, I string, A string"
    targets = spark.createDataFrame([("h", ("N", "H", "X", None, "C", "N", "", "H"), 9.5, 0.3)], f"key string, letters struct<{', '.join(x.replace(' ', ':') for x in letters.split(', '))}>, score double, loss_weight double")
    got = {r["sample_id"]: r for r in weights.training_examples(rows, targets).collect()}
    assert got["b"]["sub_labels"] == [0, 1, -100, -100, 1, 0, -100, 2] and got["b"]["class_index"] == 7 and got["b"]["cvss_score"] == 9.5 and got["b"]["is_hard_negative"]
    assert got["a"]["sub_labels"] == [-100] * 8 and math.isnan(got["a"]["cvss_score"]) and got["a"]["loss_weight"] == 0.0 and got["a"]["class_index"] == 6
