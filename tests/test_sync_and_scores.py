"""Mirror synchronisation, one-pass quarantine, resumable evaluation, intervals, curves and batches."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.operators import batches, intervals, metrics, mirror, stages
from quarry.streaming import incremental


def plan(source, target):
    """Actions by key of two lists of rows (key, value)."""
    s, m = defaultdict(list), defaultdict(list)
    for k, v in source:
        s[k].append(v)
    for k, v in target:
        m[k].append(v)
    order = lambda vs: sorted(vs, key=str)
    return {(k, "delete" if k not in s else "insert" if k not in m else "update") for k in {*s, *m} if order(s.get(k, [])) != order(m.get(k, []))}


@pytest.mark.parametrize("bits", [4, 16])
def test_a_mirror_gets_what_it_lacks(spark, bits):
    rng = random.Random(bits)
    source = [(i, rng.choice(["a", "b", None])) for i in range(2000)] + [(None, "x"), (5, "twice"), (6, "p"), (6, "p")]
    target = [(k, v if rng.random() < 0.99 else "changed") for k, v in source if rng.random() < 0.99] + [(5000 + i, "old") for i in range(7)]
    s, m = (spark.createDataFrame(rows, "k long, v string").repartition(3) for rows in (source, target))
    assert {tuple(r) for r in mirror.sync_plan(s, m, ["k"], ["v"], bits).collect()} == plan(source, target)
    assert {tuple(r) for r in mirror.sync_plan(s, m.limit(0), ["k"], ["v"], bits).collect()} == plan(source, [])


def test_an_unchanged_mirror_compares_digests_alone(spark, monkeypatch):
    rows = [(i, str(i), f"v{i}") for i in range(3000)]
    s, m = spark.createDataFrame(rows, "a long, b string, v string").repartition(5), spark.createDataFrame(rows[::-1], "a long, b string, v string").repartition(2)
    compared = []
    level = mirror.cut
    monkeypatch.setattr(mirror, "cut", lambda df: compared.append(level(df)) or compared[-1])
    assert mirror.sync_plan(s, m, ["a", "b"], ["v"]).collect() == []
    # the digests of both sides, and one comparison of their roots that finds nothing
    assert len(compared) == 3 and compared[2].isEmpty() and compared[0].count() <= 3000
    again = mirror.sync_plan(s, m.withColumn("v", F.when(F.col("a") == 77, "new").otherwise(F.col("v"))), ["a", "b"], ["v"])
    assert [tuple(r) for r in again.collect()] == [(77, "77", "update")]


def test_outcomes_are_written_and_counted_in_one_pass(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(i, "abcd"[i % 4]) for i in range(100)], "id long, kind string").repartition(3).mapInArrow(touch, "id long, kind string")
    reason = F.when(F.col("kind") == "b", "bad").when(F.col("kind") == "c", "c/odd name").when((F.col("kind") == "d") & (F.col("id") < 8), "rare")
    path = str(tmp_path / "out")
    got = {r["outcome"]: r["n"] for r in stages.write_outcomes(rows, reason, ["bad", "c/odd name", "never"], path).collect()}
    assert got == {"kept": 48, "bad": 25, "c/odd name": 25, "other": 2} and read.value == 100
    assert sorted(r["id"] for r in stages.read_outcome(spark, path, "bad").collect()) == list(range(1, 100, 4))
    assert stages.read_outcome(spark, path).columns == ["id", "kind"] and stages.read_outcome(spark, path).count() == 48
    assert stages.read_outcome(spark, path, "rare").count() == 2 and stages.read_outcome(spark, path, "c/odd name").count() == 25


def test_a_row_that_breaks_the_detector_loses_its_answer_alone():
    calls = []

    def detector(rows):
        calls.append(len(rows))
        if any(i == "s37" for i, _ in rows):
            raise ValueError("poison")
        return {i: {"CWE-89"} for i, _ in rows}

    rows = [(f"s{i}", "x") for i in range(100)]
    found, errors = incremental.ask(detector, rows)
    assert set(found) == {i for i, _ in rows} - {"s37"} and errors == {"s37": "ValueError: poison"}
    assert len(calls) <= 2 * 7 + 1


def test_a_slow_row_is_stopped():
    def detector(rows):
        for i, _ in rows:
            if i == "slow":
                time.sleep(5)
        return {i: set() for i, _ in rows}

    began = time.time()
    found, errors = incremental.ask(detector, [("a", ""), ("slow", ""), ("b", "")], 0.2)
    assert set(found) == {"a", "b"} and errors["slow"].startswith("TimeoutError") and time.time() - began < 3


def test_a_broken_row_in_a_frame(spark):
    rows = spark.createDataFrame([("clean", f"s{i}", "safe", "bad" if i == 3 else "x") for i in range(20)], "variant string, sample_id string, ground_truth string, code string").coalesce(1)

    def detector(xs):
        if any(c == "bad" for _, c in xs):
            raise OSError("no")
        return {i: {"CWE-89"} for i, _ in xs}

    got = {r["sample_id"]: (r["predicted"], r["error"]) for r in incremental.evaluate(rows, detector, "1").collect()}
    assert got.pop("s3") == ([], "OSError: no") and set(map(str, got.values())) == {str((["CWE-89"], None))}


def test_evaluation_goes_on_where_it_stopped(spark, tmp_path):
    kind = "variant string, sample_id string, ground_truth string, code string"
    rows = [(v, f"s{i}", "CWE-89", f"{v} {i}") for v in ("clean", "composed", "string_split") for i in range(10)]
    path = str(tmp_path / "records")
    first = lambda xs: {i: {"CWE-89"} for i, _ in xs}
    # an earlier run has one variant whole and one in part
    done = [r for r in rows if r[0] == "clean" or (r[0] == "composed" and r[1] < "s4")]
    _, plan_ = incremental.resumable_evaluation(spark.createDataFrame(done, kind), first, "t", "1", path)
    assert {r["variant"]: r["action"] for r in plan_.collect()} == {"clean": "run", "composed": "run"}

    def second(xs):
        if any(c.startswith("clean") for _, c in xs):
            raise ValueError("a variant that is done was run again")
        return {i: {"CWE-22"} for i, c in xs if not c.endswith("7")}

    records, plan_ = incremental.resumable_evaluation(spark.createDataFrame(rows, kind), second, "t", "2", path)
    assert {r["variant"]: r["action"] for r in plan_.collect()} == {"clean": "skip", "composed": "redo", "string_split": "run"}
    got = {(r["variant"], r["sample_id"]): r["predicted"] for r in records.collect()}
    assert got == {(v, i): (["CWE-89"] if v == "clean" else [] if i == "s7" else ["CWE-22"]) for v, i, *_ in rows}
    other, _ = incremental.resumable_evaluation(spark.createDataFrame(rows[:10], kind), lambda xs: {}, "u", "1", path)
    assert {tuple(r["predicted"]) for r in other.collect()} == {()}
    assert incremental.resumable_evaluation(spark.createDataFrame(rows, kind), second, "t", "2", path)[1].filter("action <> 'skip'").count() == 0


def curve(rows):
    """Average precision by thresholds at every distinct score."""
    rows = [(s, h) for s, h in rows if s is not None]
    p = sum(h for _, h in rows)
    out, before = 0.0, 0
    for t in sorted({s for s, _ in rows}, reverse=True):
        above = [h for s, h in rows if s >= t]
        out += (sum(above) - before) / p * sum(above) / len(above) if p else 0
        before = sum(above)
    return out if p else None


@pytest.mark.parametrize("ranges", [1, 7])
def test_areas_equal_those_of_thresholds(spark, ranges):
    rng = random.Random(ranges)
    rows = [("a", round(rng.random(), 2), rng.random() < 0.3) for _ in range(500)] + [("b", 1.0, True)] * 3 + [("b", 0.5, False)] * 2 + [("c", 0.1, False), ("d", None, True), ("a", None, True), (None, 0.2, True)]
    df = spark.createDataFrame(rows, "g string, s double, y boolean").repartition(4)
    got = {r["g"]: r["pr_auc"] for r in intervals.average_precision(df, ["g"], "s", "y", ranges).collect()}
    assert got.keys() == {"a", "b", "c", None}
    for g in ("a", "b", "c", None):
        want = curve([(s, y) for k, s, y in rows if k == g])
        assert got[g] is None if want is None else abs(got[g] - want) < 1e-12


def test_replicates_weigh_samples_alike_everywhere(spark):
    rows = [(t, "clean", f"s{i}", "CWE-89" if i % 3 else "safe", ["CWE-89"] if (i + k) % 4 else []) for k, t in enumerate(("x", "y")) for i in range(400)]
    df = spark.createDataFrame(rows, "tool string, variant string, sample_id string, ground_truth string, predicted array<string>")
    cells = intervals.replicates(df, 60).groupBy("tool", "replicate").agg(F.sum("weight").alias("w")).collect()
    sums = {(r["tool"], r["replicate"]): r["w"] for r in cells}
    assert sums["x", 0] == 400 and all(sums["x", b] == sums["y", b] for b in range(61))
    assert abs(sum(sums["x", b] for b in range(1, 61)) / 60 - 400) < 15 and len({sums["x", b] for b in range(1, 61)}) > 20
    got = {(r["tool"], r["metric"]): r for r in intervals.bootstrap_intervals(df, 60).collect()}
    plain = {r["tool"]: r["mcc"] for r in metrics.mcc(df).collect()}
    for t in ("x", "y"):
        r = got[t, "mcc"]
        assert abs(r["value"] - plain[t]) < 1e-12 and r["low"] < r["value"] < r["high"]
    assert set(got) == {(t, m) for t in ("x", "y") for m in ("mcc", "macro_f1", "kappa")}


def test_batches_hold_every_example_once_within_the_budget(spark):
    rng = random.Random(4)
    rows = [(f"e{i}", rng.choice([0, 1, 15, 16, 17, 500, 1024, 1000])) for i in range(700)] + [(f"m{i}", 100) for i in range(900)] + [("long", 1025), ("none", None), ("odd", -1)]
    df = spark.createDataFrame(rows, "id string, length long").repartition(3)
    got = batches.token_batches(df, 1024)
    out = got.collect()
    assert sorted(r["id"] for r in out) == sorted(i for i, _ in rows)
    assert {r["id"] for r in out if r["batch"] is None} == {"long", "none", "odd"}
    held = defaultdict(list)
    for r in out:
        if r["batch"] is not None:
            held[r["range"], r["batch"]].append(r)
            assert r["range"] / 2 < r["length"] <= r["range"] or r["range"] == 16
    for (bound, number), own in held.items():
        assert len(own) * bound <= 1024 and sorted(r["slot"] for r in own) == list(range(len(own)))
        assert len(own) == 1024 // bound or (bound, number + 1) not in held
    fill = {r["range"]: r["fill"] for r in batches.fill_rates(got).collect()}
    assert abs(fill[128] - 90_000 / (-(-900 // 8) * 1024)) < 1e-12
    assert batches.token_batches(df.limit(0), 64).collect() == []
