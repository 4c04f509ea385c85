import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.operators import split, weights

SCHEMA = "id string, cwe string, repo string, framework string, source string, is_hard_negative boolean, parent_sample_id string"


def corpus(spark, counts, repos=0, seed=0):
    rng = random.Random(seed)
    rows = []
    for cwe, n in counts.items():
        for i in range(n):
            rows.append((f"{cwe}_{i}", cwe, f"r{rng.randrange(repos)}" if repos else None, "django" if i % 2 else "flask", "s", False, None))
    rows += [("hn_0", "safe", None, "flask", "s", True, rows[0][0]), ("hn_1", "safe", "own", "flask", "s", True, "missing")]
    return spark.createDataFrame(rows, SCHEMA)


def placed(df):
    return {r["id"]: r["split"] for r in df.collect()}


def test_each_row_is_in_one_split_and_runs_agree(spark):
    df = corpus(spark, {"CWE-89": 50, "CWE-79": 30, "CWE-502": 8})
    a, b = placed(split.greedy_group_split(df)), placed(split.greedy_group_split(df.repartition(7)))
    assert a == b and len(a) == 90 and set(a.values()) == {"train", "val", "test"}
    assert a != placed(split.greedy_group_split(df, seed=7))


def test_no_group_is_in_two_splits(spark):
    out = split.greedy_group_split(corpus(spark, {"CWE-89": 100, "CWE-79": 60, "CWE-502": 20}, repos=15))
    assert [r["overlap"] for r in split.leakage(out).collect()] == [0, 0, 0]
    keys = {r["id"]: r["group_key"] for r in out.collect()}
    assert keys["hn_0"] == keys["CWE-89_0"] and keys["hn_1"] == "repo::own"


def test_groups_are_dealt_as_one_after_the_other(spark):
    df = corpus(spark, {"CWE-89": 300, "CWE-79": 90, "CWE-502": 20}, repos=25).unionByName(corpus(spark, {"x": 40, "y": 25})).dropDuplicates(["id"])
    rows = split.greedy_group_split(df).collect()
    groups, where = defaultdict(Counter), {}
    for r in rows:
        groups[r["group_key"]][r["cwe"]] += 1
        where[r["group_key"]] = r["split"]
    total = Counter(r["cwe"] for r in rows)
    names = ["train", "val", "test"]
    want = {"train": {c: round(n * 0.7) for c, n in total.items()}, "val": {c: round(n * 0.15) for c, n in total.items()}}
    want["test"] = {c: n - want["train"][c] - want["val"][c] for c, n in total.items()}
    kinds = defaultdict(list)
    for key, counts in groups.items():
        parts = sorted((-n, c) for c, n in counts.items())
        kinds[-sum(counts.values()), tuple(c for _, c in parts), tuple(n for n, _ in parts)].append(key)
    for (_, classes, less), keys in sorted(kinds.items()):
        got = Counter()
        for _ in keys:
            best = max(names, key=lambda s: (want[s][classes[0]], -names.index(s)))
            got[best] += 1
            for c, n in zip(classes, less, strict=True):
                want[best][c] += n
        assert Counter(where[k] for k in keys) == got


@pytest.mark.parametrize(("lacks", "weight", "m"), [([10, 5, 5], 3, 4), ([0, 0, 0], 1, 7), ([-5, 2, 2], 4, 5), ([7, 1, 1], 1, 0), ([100, 3, 50], 7, 33)])
def test_equal_groups_are_dealt_in_one_step(lacks, weight, m):
    left, want = list(lacks), [0, 0, 0]
    for _ in range(m):
        s = max(range(3), key=lambda i: (left[i], -i))
        want[s] += 1
        left[s] -= weight
    assert split._dealt(lacks, weight, m) == want


def test_ordered_rank_counts_within_values(spark):
    rows = [(f"i{n * 37 % 1000:04}", None if n % 3 == 0 else "ab"[n % 2]) for n in range(400)]
    got = {r["id"]: r["r"] for r in split.ordered_rank(spark.createDataFrame(rows, "id string, k string"), "k", "id", 4).collect()}
    for value in (None, "a", "b"):
        ids = sorted(i for i, k in rows if k == value)
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))


def test_proportions(spark):
    out = split.greedy_group_split(corpus(spark, {"CWE-89": 400, "CWE-79": 200}))
    n = Counter(r["split"] for r in out.collect())
    assert abs(n["train"] / 602 - 0.7) < 0.02 and abs(n["val"] / 602 - 0.15) < 0.02


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        split.greedy_group_split(corpus(spark, {"a": 3}), fractions=(0.5, 0.1, 0.1))
    with pytest.raises(ValueError):
        split.greedy_group_split(spark.createDataFrame([], SCHEMA))


@pytest.mark.parametrize(("n", "want"), [(1, (1, 0, 0)), (2, (1, 1, 0)), (3, (1, 1, 1)), (9, (7, 1, 1)), (10, (7, 2, 1)), (100, (70, 15, 15))])
def test_stratified_sizes(spark, n, want):
    df = spark.createDataFrame([(f"i{i}", "c") for i in range(n)], "id string, cwe string")
    c = Counter(r["split"] for r in split.stratified_split(df).collect())
    assert (c["train"], c["val"], c["test"]) == want


def test_cap_keeps_rows_without_group(spark):
    df = spark.createDataFrame([(i, "c", None if i % 3 == 0 else "g") for i in range(9)], "id int, cwe string, cve_id string")
    kept = [r["id"] for r in split.cap_per_group(df, ["cwe", "cve_id"], 2, ["id"]).filter("kept").collect()]
    assert sorted(kept) == [0, 1, 2, 3, 6]


COUNTS = {"CWE-89": 148, "CWE-78": 17, "CWE-22": 9, "CWE-79": 40, "CWE-94": 24, "CWE-918": 17, "CWE-502": 51, "safe": 300}
#: published weights and margins of these counts
WEIGHTS = {"CWE-89": 0.176668, "CWE-78": 1.441790, "CWE-22": 2.712527, "CWE-79": 0.619818, "CWE-94": 1.024838, "CWE-918": 1.441790, "CWE-502": 0.488794, "safe": 0.093775}


def test_published_weights_and_margins(spark):
    counts = weights.with_label_order(spark, spark.createDataFrame(list(COUNTS.items()), "cwe string, n long"))
    got = {r["cwe"]: r["weight"] for r in weights.effective_number(counts).collect()}
    assert all(abs(got[k] - v) < 1e-6 for k, v in WEIGHTS.items()) and abs(sum(got.values()) - 8) < 1e-9
    margins = {r["cwe"]: r["margin"] for r in weights.ldam_margins(counts).collect()}
    assert abs(margins["CWE-89"] - 0.248293) < 1e-6 and margins["CWE-22"] == 0.5 and abs(margins["safe"] - 0.208090) < 1e-6


def test_missing_class_has_no_weight(spark):
    counts = spark.createDataFrame([("A", 100), ("missing", 0)], "cwe string, n long")
    assert {r["cwe"]: r["weight"] for r in weights.effective_number(counts).collect()} == {"A": 2.0, "missing": 0.0}
    assert {r["cwe"]: r["margin"] for r in weights.ldam_margins(counts).collect()}["missing"] == 0.5


def test_draws_have_the_expected_number(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 4 + 1.0).alias("weight"))
    by = defaultdict(int)
    for r in weights.weighted_draws(df, 10_000, 3).collect():
        by[r["weight"]] += r["times"]
    assert all(abs(by[w] - 10_000 * w * 500 / 5000) < 80 for w in (1.0, 2.0, 3.0, 4.0))
    assert weights.drw_phases(10, 0.8) == (8, 2)


def test_oversample_and_features(spark):
    df = spark.createDataFrame([("a", "CWE-502"), ("b", "CWE-89"), ("c", "other")], "id string, cwe string")
    assert Counter(r["id"] for r in weights.oversample(df).collect()) == {"a": 8, "b": 1, "c": 1}
    assert {r["id"]: r["class_index"] for r in weights.feature_rows(df).collect()} == {"a": 6, "b": 0, "c": 7}
    assert abs(spark.range(1).select(weights.nll(F.lit(1.0), F.lit(0.0), F.lit(3.0))).first()[0] - 2.0) < 1e-12
