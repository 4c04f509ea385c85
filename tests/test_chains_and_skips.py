"""Parent chains, skip sets, the literal prefilter and stateful ingestion."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quarry.functions import constants as K
from quarry.functions import prefilter, syntax
from quarry.functions import text as X
from quarry.operators import curate, hierarchy, skipsets, split
from quarry.streaming import incremental


def ends(parents):
    out = {}
    for i in parents:
        at, seen = i, set()
        while at in parents and at not in seen:
            seen.add(at)
            at = parents[at]
        out[i] = (None, True) if at in parents else (at, False)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_chains_of_any_length_end_at_their_roots(spark, seed):
    rng = random.Random(seed)
    parents = {f"n{i}": f"n{i - 1}" for i in range(1, 200)} | {f"c{i}": f"c{(i + 1) % 7}" for i in range(7)} | {"into": "c3", "self": "self", "x": "nowhere"}
    parents |= {f"r{i}": f"r{rng.randrange(i)}" for i in range(1, 60)}
    rows = [*parents.items(), (None, "n1"), ("lonely", None)]
    rng.shuffle(rows)
    got = hierarchy.chain_ends(spark.createDataFrame(rows, "id string, parent string")).collect()
    assert {r["id"]: (r["end"], r["cyclic"]) for r in got} == ends(parents)


def test_hard_negatives_inherit_up_their_chain(spark):
    rows = [("a", "x", False, None), ("b", None, True, "a"), ("c", "y", True, "b"), ("d", "", True, "c"), ("o", "z", True, "gone"), ("p", None, True, "o"), ("q", "w", True, "r"), ("r", None, True, "q"), ("s", None, False, "a"), ("t", None, True, "s"), ("u", "v", None, "a")]
    out = split.group_keys(spark.createDataFrame(rows, "id string, repo string, is_hard_negative boolean, parent_sample_id string"))
    assert {r["id"]: r["group_key"] for r in out.collect()} == {"a": "repo::x", "b": "repo::x", "c": "repo::x", "d": "repo::x", "o": "repo::z", "p": "repo::z", "q": "repo::w", "r": "solo::r", "s": "solo::s", "t": "solo::s", "u": "repo::v"}


def test_chains_keep_every_row_of_a_hot_parent(spark):
    rows = [("root", "r", False, None)] + [(f"k{i}", None, True, "root") for i in range(3000)] + [(f"g{i}", None, True, f"k{i}") for i in range(100)]
    out = split.group_keys(spark.createDataFrame(rows, "id string, repo string, is_hard_negative boolean, parent_sample_id string"))
    assert [tuple(r) for r in out.groupBy("group_key").count().collect()] == [("repo::r", 3101)]


@pytest.mark.parametrize("bits", [None, 1 << 10])
def test_skip_sets_equal_an_anti_join(spark, monkeypatch, bits):
    """With a filter that is far too small all rows are compared exactly."""
    if bits:
        monkeypatch.setattr(skipsets, "MOST_BITS", bits)
    rng = random.Random(1)
    known = [(f"r{rng.randrange(60)}", rng.randrange(80), "c" * rng.randrange(3)) for _ in range(3000)] + [(None, 1, "c"), ("r1", None, "")]
    rows = [(f"r{rng.randrange(60)}", rng.randrange(160), "c" * rng.randrange(3), i) for i in range(2000)] + [(None, 1, "c", -1), ("r1", None, "", -2), (known[0] + (-3,)), (known[0] + (-4,))]
    k = spark.createDataFrame(known, "repo string, sha long, cve string")
    n = spark.createDataFrame(rows, "repo string, sha long, cve string, i long").repartition(3)
    there = set(known)
    got = skipsets.skip_known(n, k, ["repo", "sha", "cve"]).collect()
    assert sorted(r["i"] for r in got) == sorted(r[3] for r in rows if None in r[:3] or r[:3] not in there)
    assert skipsets.skip_known(n, k.limit(0), ["repo", "sha"]).count() == len(rows)
    assert skipsets.skip_known(n.limit(0), k, ["repo", "sha"]).count() == 0


def test_a_filter_holds_its_keys_and_few_others(spark):
    known, other = spark.range(5000), spark.range(5000, 25000)
    bits = skipsets.filter_bits(5000)
    words = skipsets.bloom_words(known, ["id"], bits)
    assert words.count() == 1 and len(words.first()["words"]) == bits // 64
    hits = lambda df: df.filter(skipsets.may_hold(words.scalar(), [F.col("id")], bits)).count()
    assert hits(known) == 5000 and hits(other) < 200


ALL = sorted({p for group in (K.SINKS, K.UNSAFE, K.SECURE, K.SUPPORT, K.AUDIT) for ps in group.values() for p in ps} | {K.TAINT_AUDIT, K.REQUEST_TAINT, K.TAINT_SOURCE, K.TEST_PATH, K.CREDENTIAL, *K.FRAMEWORKS.values(), *K.AUDIT_ATTACK})


def pieces():
    out = ["cursor.EXECUTE (", "execute(f'", "SELECT a FROM", "pickle.loads(", "yaml.load(", "os . system (", "eval(", "requſt", "request.args", "REQUEST . form", "shell=True", "../..", "mark_safe(", "|safe", "import FLASK", "from flaſk", "Kind", "open (", "password = 'abcdefg'", "\n", "# nosec", "subprocess.run(x, shell = True"]
    return out


@pytest.mark.parametrize("seed", range(5))
def test_no_pattern_matches_that_is_not_possible(seed):
    rng = random.Random(seed)
    literals = prefilter.Literals(ALL)
    compiled = [re.compile(p) for p in literals.patterns]
    found = 0
    for _ in range(400):
        text = " ".join(rng.choice(pieces()) if rng.random() < 0.7 else "word" + str(rng.random()) for _ in range(rng.randrange(12)))
        possible = set(literals.possible(text))
        matching = {i for i, p in enumerate(compiled) if p.search(text)}
        found += len(matching)
        assert matching <= possible, (text, [literals.patterns[i] for i in matching - possible])
    assert found > 500


def test_required_strings():
    assert prefilter.required(r"(?i)\.execute(?:many|script)?\s*\(") == {".execute"}
    assert prefilter.required(r"\bos\s*\.\s*(system|popen)\s*\(") == {"system", "popen"}
    assert prefilter.required(r"(?i)x*|y") == frozenset()
    assert sum(not prefilter.required(p) for p in ALL) <= 2
    assert prefilter.Literals(ALL).possible(None) is None
    without = prefilter.Literals(ALL)
    with_automaton, without.automaton = without.possible("x = pickle.loads(request.data)"), None
    assert without.possible("x = pickle.loads(request.data)") == with_automaton


def test_signals_by_possible_patterns_are_the_same(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(pieces()) for _ in range(rng.randrange(10)))) for i in range(200)] + [(200, None), (201, "")]
    df = spark.createDataFrame(rows, "i long, code string").withColumn("p", curate.SIGNALS.possible(F.col("code")))
    for c in curate.CLASS_SIGNALS:
        plain, fast = curate.class_signals(F.col("code"), c), curate.class_signals(F.col("code"), c, F.col("p"))
        differs = df.filter(~F.struct(*plain.values()).eqNullSafe(F.struct(*fast.values())))
        assert differs.count() == 0, c


def test_the_gate_gives_the_first_pattern_as_before():
    rng = random.Random(5)
    for _ in range(500):
        code = "\n".join(rng.choice(pieces()) for _ in range(rng.randrange(8)))
        cwe = rng.choice([*K.SINKS, "safe"])
        bare = syntax.strip_comments(code)
        want = (True, None) if cwe == "safe" else (False, None)
        for p in syntax.SINKS.get(cwe, ()):
            lines = [m for m in p.finditer(bare) if not syntax.SUPPRESSED.search(code[code.rfind("\n", 0, m.start()) + 1 : (code + "\n").index("\n", m.start())])]
            if any(cwe not in K.NEEDS_REQUEST or syntax.request_near(code, m.start()) for m in lines):
                want = True, p.pattern
                break
        assert syntax.gate(code, cwe, "src/a.py") == want


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps({"id": i, "code": c}) + "\n" for i, c in rows))


def test_state_holds_what_was_seen_over_restarts(spark, tmp_path):
    src, target, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    known = spark.createDataFrame([("old",), (None,)], "code string").select(X.code_hash(F.col("code")).alias("content_hash"))
    run = lambda: incremental.stream_ingest(spark, src, "id string, code string", target, state, lambda df: df.filter("code <> 'bad'"), known).awaitTermination(120)
    rows = lambda: sorted(r["code"] for r in incremental.read_ingested(spark, target, state).collect())
    write(tmp_path / "in", "1.json", [("a", "x"), ("b", "x"), ("c", "old"), ("d", None), ("e", "y")])
    run()
    assert rows() == ["x", "y"]
    write(tmp_path / "in", "2.json", [("f", "y"), ("g", "z"), ("h", "old"), ("i", "bad")])
    run()
    run()
    assert rows() == ["x", "y", "z"]
    # the target is never read: with it out of the way, the state alone knows what was seen
    (tmp_path / "out").rename(tmp_path / "moved")
    write(tmp_path / "in", "3.json", [("j", "x"), ("k", "z"), ("l", "new")])
    run()
    assert sorted(r["code"] for r in spark.read.parquet(target).collect()) == ["new"]


def test_a_batch_that_was_written_and_not_committed_is_written_again(spark, tmp_path):
    src, target, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    run = lambda: incremental.stream_ingest(spark, src, "id string, code string", target, state).awaitTermination(120)
    write(tmp_path / "in", "1.json", [("a", "x"), ("b", "y")])
    run()
    write(tmp_path / "in", "2.json", [("c", "y"), ("d", "z")])
    run()
    last = max(int(p.name) for p in (tmp_path / "ck" / "commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "ck" / "commits").iterdir():
        if str(last) in p.name:
            p.unlink()
    assert sorted(r["code"] for r in incremental.read_ingested(spark, target, state).collect()) == ["x", "y"]
    run()
    assert sorted(r["code"] for r in spark.read.parquet(target).collect()) == ["x", "y", "z"]


def test_batches_take_no_longer_as_the_target_grows(spark, tmp_path):
    src, target, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    took = []
    for b in range(4):
        write(tmp_path / "in", f"{b}.json", [(str(i), f"code {b} {i}") for i in range(500)])
        began = time.time()
        incremental.stream_ingest(spark, src, "id string, code string", target, state).awaitTermination(120)
        took.append(time.time() - began)
    assert spark.read.parquet(target).count() == 2000
    assert min(took[2:]) < 2.5 * min(took[:2])
