import pytest
from pyspark.sql import functions as F

from quarry.functions import constants as K
from quarry.operators import metrics
from quarry.plans import fixtures as S

BASE = [("a", "CWE-89", ["CWE-89"]), ("b", "CWE-89", ["CWE-79"]), ("c", "CWE-79", ["CWE-89"]), ("d", "safe", []), ("e", "safe", ["CWE-89"])]


def frame(spark, rows, variant="clean"):
    return spark.createDataFrame([("t", variant, i, g, p) for i, g, p in rows], S.GOLD_DDL)


def cells(spark, rows):
    return {r["cwe"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in metrics.confusion(frame(spark, rows)).collect()}


def test_one_versus_rest(spark):
    got = cells(spark, BASE)
    assert got["CWE-89"] == (1, 2, 1, 1) and got["CWE-79"] == (0, 1, 1, 3)
    assert cells(spark, [("a", "CWE-89", ["CWE-89", "CWE-94"])])["CWE-94"] == (0, 1, 0, 0)


def test_macro_over_present_classes(spark):
    rows = [("a", "CWE-89", ["CWE-89"]), ("b", "CWE-89", ["CWE-89"]), ("c", "CWE-79", [])]
    assert metrics.macro_f1(frame(spark, rows)).first()["macro_f1"] == 0.5


def test_drop_uses_shared_ids(spark):
    both = frame(spark, [("a", "CWE-89", ["CWE-89"]), ("b", "CWE-79", ["CWE-79"])]).union(frame(spark, [("a", "CWE-89", ["CWE-89"]), ("b", "CWE-79", [])], "string_split"))
    assert metrics.robustness_drop(both).first()["drop"] == 0.5
    some = frame(spark, [("a", "CWE-89", ["CWE-89"]), ("s", "safe", ["CWE-89"])]).union(frame(spark, [("a", "CWE-89", ["CWE-89"])], "string_split"))
    assert metrics.robustness_drop(some).first()["drop"] == 0.0


def test_undefined_values(spark):
    only = frame(spark, [("a", "CWE-89", ["CWE-89"])])
    assert metrics.mcc(only).first()["mcc"] is None
    none = spark.createDataFrame([], "sample_id string, score double")
    r = metrics.severity_weighted_recall(only, none).first()
    assert (r["swr"], r["pool"], r["excluded"]) == (0.0, 0, 1)
    assert metrics.weighted_kappa(frame(spark, [("a", "safe", []), ("b", "safe", [])])).first()["kappa"] is None


def test_published_record_scores(spark):
    r = metrics.score_bundle(spark.createDataFrame(S.GOLD, S.GOLD_DDL), spark.createDataFrame([("a", 5.0)], "sample_id string, score double")).first()
    assert r["macro_f1"] == 0.5 and abs(r["hcma"] - 0.4166667) < 1e-6 and abs(r["kappa"] - 0.1666667) < 1e-6 and r["observed_agreement"] == 0.4


@pytest.mark.parametrize(("a", "b", "value"), [("78", "79", 4 / 7), ("78", "89", 4 / 7), ("79", "94", 2 / 3), ("22", "502", 1 / 3), ("918", "502", 1 / 3), ("22", "79", 0.0), ("89", "89", 1.0)])
def test_tree_similarity(spark, a, b, value):
    assert abs(metrics.SIMILARITY[f"CWE-{a}", f"CWE-{b}"] - value) < 1e-12


def test_similarity_from_the_recursive_query(spark):
    got = {(r["a"], r["b"]): r["similarity"] for r in metrics.wu_palmer(spark).collect()}
    assert len(got) == 49 and all(abs(got[p] - metrics.SIMILARITY[p]) < 1e-12 for p in got)


def test_unknown_predictions_do_not_count(spark):
    x = spark.range(1).select(metrics.best_similarity(F.array(F.lit("CWE-1"), F.lit("CWE-89")), F.lit("CWE-79")).alias("a"), metrics.best_similarity(F.array().cast("array<string>"), F.lit("CWE-79")).alias("b")).first()
    assert abs(x["a"] - 2 / 3) < 1e-12 and x["b"] == 0.0
    assert set(K.TARGETS) < set(K.LABELS)
