import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat_format, topk_search
from quarry.llm.mixing import mix
from quarry.llm.queries import SPECIAL_CONVERSATION
from quarry.llm.topk_search import top_k

VECTORS = "vec_id long, embedding array<double>, v int, part string, id int"


def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(230)]
    rows[60] = (60, rows[50][1])
    rows += [(300, None), (350, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, [math.nan] + [0.0] * 5), (450, [math.inf] + [0.0] * 5), (None, [1.0] * 6), (500, [1.0, 2.0]), (501, [3.0, -1.0]), (550, []), (7, rows[7][1])]
    return rows


def brute(rows, k):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in whole if i % 50 == 0}.items():
        scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v)]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("tile", "block", "fan"), [(2048, 2048, 64), (7, 2, 2)])
def test_top_k_is_exact(spark, monkeypatch, tile, block, fan):
    monkeypatch.setattr(topk_search, "TILE_ROWS", tile)
    monkeypatch.setattr(topk_search, "TILE_QUERIES", block)
    monkeypatch.setattr(topk_search, "BLOCK_BYTES", block * 64)
    monkeypatch.setattr(topk_search, "FAN_IN", fan)
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "p", 2) for i, v in rows], VECTORS).repartition(6)
    got = sorted(tuple(r) for r in top_k(df, df.filter(F.col("vec_id") % 50 == 0), 5).collect())
    assert got == brute(rows, 5)


def test_large_components_stay_exact(spark):
    rows = [(0, [1e7, -3e6]), (1, [1e7 + 1 / 256, 5e6]), (2, [1e7, 5e6 + 1 / 256])]
    df = spark.createDataFrame([(i, v, 1, "p", 2) for i, v in rows], VECTORS)
    assert sorted(tuple(r) for r in top_k(df, df.filter("vec_id = 0")).collect()) == [r for r in brute(rows, 5) if r[0] == 0]


def test_products_of_any_size_are_exact_or_refused():
    a = np.array([[2**40, 2**40, -(2**40)], [3, 1, 2]])
    b = np.array([[2**20, 2**30, 2**30 - 1], [2**22, -5, 2**22]])
    assert topk_search._products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in b] for r in a]
    with pytest.raises(OverflowError):
        topk_search._products(np.array([[2**40] * 4]), np.array([[2**40] * 4]))


def test_components_beyond_the_domain_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e300], 1, "p", 2), (1, [1.0], 1, "p", 2)], VECTORS)
    with pytest.raises(Exception, match="2\\^53"):
        top_k(df, df).collect()


def test_thousands_of_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_BYTES", 2000 * 48)
    rng = np.random.default_rng(8)
    vectors = rng.integers(-200, 200, (5000, 4))
    df = spark.createDataFrame([(i, [float(x) / 256 for x in v], 1, "p", 2) for i, v in enumerate(vectors)], VECTORS).repartition(5)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k(df, df, 2).collect()}
    scores = vectors @ vectors.T
    np.fill_diagonal(scores, -(10**9))
    order = np.lexsort((np.broadcast_to(np.arange(5000), scores.shape), -scores), axis=1)
    assert len(got) == 10000
    assert all(got[q, r + 1] == (order[q, r], scores[q, order[q, r]]) for q in range(5000) for r in range(2))


def test_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert top_k(none, none).collect() == []


CHATS = "conv_id long, turn long, role string, text string, tree string"


def conversations():
    return [
        (1, 0, "system", "a|b <|im_start|> <\\|x"), (1, 1, "user", "hi\nthere "), (1, 2, "assistant", "<|<\\\\|"), (1, 2, "assistant", "<|<\\\\|"),
        (2, 5, None, None), (2, None, "assistant", "first %25\n"), (2, 3, "odd\n<role>%", ""), (None, 1, "user", "x" * 100_000), (None, 0, "assistant", "é日"),
        (3, 0, "assistant", ""), (-1, 0, "user", SPECIAL_CONVERSATION), (-1, 1, "assistant", SPECIAL_CONVERSATION), (4, 0, "user", "$1 \\1 \\"),
    ]


def test_chats_read_back(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "z") for r in rows], CHATS)
    out = chat_format.format_chats(chat_format.linear_messages(df))
    got = {r["tree"]: (r["turns"], r["loss"], r["n_turns"], r["formatted"], r["loss_spans"]) for r in out.select("tree", "n_turns", "formatted", "loss_spans", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        read, loss, n, formatted, spans = got[c]
        assert [tuple(t) for t in read] == turns and n == len(turns)
        assert loss == "".join(t for r, t in turns if r == "assistant")
        assert formatted.count("<|im_start|>") == formatted.count("<|im_end|>") == len(turns)
        assert all(formatted[s["start"] : s["start"] + s["length"]].count("<|") == 0 for s in spans)
    assert chat_format.format_chats(chat_format.linear_messages(spark.createDataFrame([], CHATS))).collect() == []


def test_best_branches_of_trees(spark):
    m = [("t", "a", None, "user", "A", 0.0), ("t", "b", "a", "assistant", "B", 1.0), ("t", "c", "a", "assistant", "C", 2.0), ("t", "d", "b", "user", "D", 5.0), ("t", "e", "c", "user", "E", None), ("u", "x", "gone", "user", "X", 0.0), ("w", "p", "q", "user", "P", 0.0), ("w", "q", "p", "user", "Q", 0.0), ("w", "r", "q", "user", "R", 0.0), ("t", None, "a", "user", "N", 9.0), ("t", "d", "b", "user", "D", 5.0)]
    df = spark.createDataFrame(m, "tree string, node string, parent string, role string, text string, score double")
    turns = lambda k: {(r["tree"], r["branch"]): "".join(t["text"] for t in r["turns"]) for r in chat_format.format_chats(df, k).select("tree", "branch", chat_format.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert turns(1) == {("t", 1): "ABD", ("u", 1): "X"}
    assert turns(5) == {("t", 1): "ABD", ("t", 2): "ACE", ("u", 1): "X"}


def test_a_wide_tree_lists_its_chosen_path_alone(spark, monkeypatch):
    """A trunk of 200 messages with a reply at each: 200 leaves, whose paths have 20,000 messages."""
    rng = np.random.default_rng(2)
    score = [float(x) for x in rng.integers(-9, 9, 400)]
    trunk = [("t", f"t{i:03}", f"t{i - 1:03}" if i else None, "user", f"T{i} ", score[i]) for i in range(200)]
    replies = [("t", f"r{i:03}", f"t{i:03}", "assistant", f"R{i}", score[200 + i]) for i in range(200)]
    df = spark.createDataFrame(trunk + replies, "tree string, node string, parent string, role string, text string, score double")
    total = np.cumsum(score[:200]) + np.array(score[200:])
    order = sorted(range(200), key=lambda i: (-total[i], f"r{i:03}"))
    listed = []
    whole = chat_format.leaf_paths
    monkeypatch.setattr(chat_format, "leaf_paths", lambda *a: listed.append(whole(*a)) or listed[-1])
    out = chat_format.format_chats(df, 2).select("branch", chat_format.read_turns(F.col("formatted")).alias("t")).collect()
    assert {r["branch"]: r["t"][-1]["text"] for r in out} == {k + 1: f"R{order[k]}" for k in range(2)}
    assert sum(p.count() for p in listed) == sum(order[k] + 2 for k in range(2))


def test_deep_paths(spark):
    rows = [("c", str(i), str(i - 1) if i else None, "user", str(i % 10), 0.0) for i in range(100)]
    df = spark.createDataFrame(rows, "tree string, node string, parent string, role string, text string, score double")
    r = chat_format.format_chats(df).select(chat_format.read_turns(F.col("formatted")).alias("t")).first()
    assert "".join(t["text"] for t in r["t"]) == "0123456789" * 10


LEVELS = {"lang": F.col, "source": F.col}


def water(total, nodes):
    """Budgets by repeated sharing among the nodes that are not full."""
    out = {k: 0.0 for k in nodes}
    left, open_ = total, {k for k, (w, cap) in nodes.items() if w > 0 and cap > 0}
    while open_ and left > 1e-9:
        share = left / sum(nodes[k][0] for k in open_)
        full = {k for k in open_ if nodes[k][1] - out[k] <= nodes[k][0] * share + 1e-9}
        for k in full or open_:
            add = nodes[k][1] - out[k] if full else nodes[k][0] * share
            out[k] += add
            left -= add
        open_ -= full or open_
    return out


@pytest.mark.parametrize(("fraction", "epochs", "weights"), [(0.5, 2, {("en",): 3, (None, "src0"): 2}), (3.0, 2, {}), (0.9, 1, {("fr",): 0.1, ("en", "odd"): 0.0}), (0.0, 2, {})])
def test_mix_meets_its_budgets(docs, local, fraction, epochs, weights):
    out = mix(docs, {k: F.col(k) for k in LEVELS}, weights, fraction, epochs).collect()
    tokens = lambda t: len((t or "").split())
    size, seen = defaultdict(int), defaultdict(int)
    for r in local:
        size[r["lang"], r["source"]] += tokens(r["text"])
    weight = lambda *p: weights.get(tuple(p), weights.get((*[None] * (len(p) - 1), p[-1]), 1)) if len(p) > 1 else weights.get(tuple(p), 1)
    cap = {k: n * epochs * (weight(k[0]) > 0) * (weight(*k) > 0) for k, n in size.items()}
    top = {a: (weight(a), sum(c for k, c in cap.items() if k[0] == a)) for a in {k[0] for k in size}}
    budget = water(min(fraction * sum(size.values()), sum(cap.values())), top)
    want = {k: v for a in top for k, v in water(budget[a], {k: (weight(*k), cap[k]) for k in size if k[0] == a}).items()}
    for r in out:
        assert 0 <= r["_used_tokens"] <= r["_n_tokens"] == tokens(r["text"]) and 0 <= r["_epoch"] < epochs + 1 and r["k0"] in ("k", None)
        seen[tuple(r["_path"])] += r["_used_tokens"]
    for k in size:
        assert abs(seen[k] - want[k]) <= 1, k


def test_prefixes_follow_the_seeded_order(spark):
    rows = [(i, "w " * (1 + i % 7), "en", "s") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = sorted((r["_epoch"], r["doc_id"], r["_used_tokens"]) for r in mix(df, {"lang": F.col("lang")}, {}, 1.4, 3, seed=9).collect())
    total = sum(1 + i % 7 for i in range(300))
    left, want = int(1.4 * total + 1e-6) - total, [(0, i, 1 + i % 7) for i in range(300)]
    for i in sorted(range(300), key=lambda i: hashlib.sha256(f"9:1:{i}".encode()).hexdigest()):
        if left > 0:
            want.append((1, i, min(left, 1 + i % 7)))
            left -= 1 + i % 7
    assert out == sorted(want)


def test_mix_of_nothing(empty):
    assert mix(empty, {"lang": F.col("lang")}, {}).collect() == []
