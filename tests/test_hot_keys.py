"""One key that half of all rows have is spread over the tasks."""

import random

from pyspark.sql import functions as F

from quarry.operators import curate, split, stages


def largest_share(df):
    """The share of rows in the largest partition of a frame's result."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


def hot(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 2 else f"k{i % 50}", f"source_type_{rng.random()}") for i in range(8000)] + [(None, "z"), (None, "a"), ("k1", None)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, id string").repartition(4)


def test_first_rows_of_a_hot_key(spark):
    rows, df = hot(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = curate.keep_first(df, F.col("k"), ["id"])
        got = {(r["k"], r["id"]) for r in out.filter("kept").collect()}
        assert largest_share(out) < 0.5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    least = {}
    for k, i in rows:
        # a null comes first
        least[k] = min(least.get(k, (i is not None, i or "")), (i is not None, i or ""))
    assert got == {(k, v[1] or None) for k, v in least.items()}
    assert out.count() == len(rows) and out.columns == ["k", "id", "kept"]


def test_one_of_equal_rows_is_first(spark):
    df = spark.createDataFrame([("a", 1)] * 5 + [("b", 2)], "k string, i int")
    assert sorted(tuple(r) for r in curate.keep_first(df, F.col("k"), ["i"]).filter("kept").collect()) == [("a", 1, True), ("b", 2, True)]


def test_ranks_of_a_hot_value_with_one_prefix(spark):
    rows, df = hot(spark)
    out = split.ordered_rank(df, "k", "id", 16)
    got = {(r["k"], r["id"]): r["r"] for r in out.collect()}
    by = {}
    for k, i in rows:
        by.setdefault(k, []).append(i)
    want = {(k, i): n + 1 for k, ids in by.items() for n, i in enumerate(sorted(ids, key=lambda i: (i is not None, i or "")))}
    assert got == want
    assert largest_share(out) < 0.35


def test_canonical_insert_of_many_equal_contents(spark):
    fine = "import os\nos.system(x)\n"
    rows = [(f"i{n:04}", "CWE-78", fine if n % 2 else f"os.system({n})", "src/a.py", "s", False) for n in range(400)] + [("j", "CWE-78", "x = 1", "src/a.py", "s", False)]
    df = spark.createDataFrame(rows, "id string, cwe string, code string, path string, source string, is_hard_negative boolean")
    old = spark.createDataFrame([("os.system(4)",)], "code string")
    got = {r["id"]: r["action"] for r in stages.canonical_insert(old, df).collect()}
    assert got["i0001"] == "inserted" and got["i0003"] == "present" and got["i0004"] == "present" and got["i0006"] == "inserted" and got["j"] == "rejected"
    assert sum(a == "inserted" for a in got.values()) == 200
