import re

import numpy as np
import pytest

from quarry.llm import decontaminate
from quarry.llm.decontaminate import find_leaks

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(texts, items, size):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    ids |= {str(x) for x in got if x is not None}
        out.append((len(w), len(hit), ",".join(sorted(ids))))
    return out


@pytest.fixture(scope="module")
def items(local):
    texts = [r["text"] for r in local if r["text"] and len(r["text"].split()) > 60]
    cut = lambda t, a, b: " ".join(t.split()[a:b])
    return [(10, cut(texts[0], 5, 30)), (9, cut(texts[1], 0, 10).upper()), (9, cut(texts[2], 3, 14)), (7, "w1"), (8, "Wörter"), (6, ""), (5, None), (None, cut(texts[3], 20, 40)), (4, cut(texts[0], 5, 30)), (3, "not in there at all, one two three four five six seven"), (2, "w3 w4")]


@pytest.fixture(scope="module")
def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def check(out, local, items, size=10):
    got = sorted((str(r["doc_id"]), r["_n_words"], r["_n_hit"], ",".join(r["_item_ids"])) for r in out.collect())
    assert got == sorted((str(r["doc_id"]), *w) for r, w in zip(local, brute([r["text"] for r in local], items, size), strict=True))


def test_same_hits_as_brute_force(docs, benchmark, local, items):
    check(find_leaks(docs, benchmark, keep=("doc_id", "k0", "t")), local, items)


def test_with_text_and_other_size(docs, benchmark, local, items):
    check(find_leaks(docs, benchmark, 4, keep=("doc_id", "text")), local, items, 4)


def test_blocks_of_the_benchmark(docs, benchmark, local, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    check(find_leaks(docs, benchmark), local, items)


def test_longest_matches(spark):
    item = " ".join(f"a{i}" for i in range(30))
    doc = "x y " + " ".join(f"a{i}" for i in range(3, 20)) + " z " + " ".join(f"a{i}" for i in range(5, 16))
    one = lambda t: spark.createDataFrame([(1, t)], "doc_id long, text string")
    r = find_leaks(one(doc), one(item), item_id="doc_id").first()
    assert [m.asDict() for m in r["_matches"]] == [{"item_id": "1", "doc_word": 2, "item_word": 3, "n_words": 17}]
    assert [tuple(s) for s in r["_hit_spans"]] == [(2, 19), (20, 31)] and r["_n_hit"] == 28


def test_empty_tables(spark, docs, empty, benchmark, local):
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(empty, benchmark).collect() == []
    out = find_leaks(docs, none).collect()
    assert len(out) == len(local) and all(r["_n_hit"] == 0 and r["_item_ids"] == [] for r in out)


def test_complementary_thue_morse_words_are_told_apart(spark):
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    docs = spark.createDataFrame([(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits))], "doc_id long, text string")
    items = spark.createDataFrame([(7, "".join("ab"[b] for b in bits))], "item_id long, text string")
    assert {(r["doc_id"], r["_n_hit"]) for r in find_leaks(docs, items).collect()} == {(1, 1), (2, 0)}


def longest(text, item, size):
    """Words of the longest match of windows, with its place in text and in item."""
    a, b = words(text), words(item)
    size = min(size, len(b))
    best = None
    for i in range(len(a) - size + 1):
        for j in range(len(b) - size + 1):
            if a[i : i + size] == b[j : j + size] and not (i and j and a[i - 1 : i + size - 1] == b[j - 1 : j + size - 1]):
                n = size
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                best = min(best or (0,), (-n, i, -j))
    return best and (-best[0], best[1], -best[2])


@pytest.mark.parametrize("pairs", [1, 40, 1 << 19])
def test_longest_matches_in_any_portion(spark, monkeypatch, pairs):
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    stop = "one two three four".split()
    items = [(1, " ".join(stop * 6)), (2, "x y one two three four one two z"), (3, "one two three four one two three q r"), (4, "two three"), (5, "a b c d e f g h")]
    texts = [" ".join(stop * 9), "c d e f g h a b c d e f g h", "y one two three four one two z one two three four one two three q r", "", "two three two three"]
    got = find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"), size=5).collect()
    for r in got:
        want = {(str(i), *m) for i, t in items if (m := longest(texts[r["doc_id"]], t, 5))}
        assert {(m["item_id"], m["n_words"], m["doc_word"], m["item_word"]) for m in r["_matches"]} == want


def test_a_window_of_many_items_and_places_is_searched_in_portions():
    import tracemalloc

    import numpy as np

    window = " ".join(f"w{i}" for i in range(10))
    block = decontaminate.Windows([str(i) for i in range(4000)], [f"{window} own{i}" for i in range(4000)], 10)
    at = np.arange(2000) * 11
    tracemalloc.start()
    found = decontaminate._longest_matches(np.full(2000, np.flatnonzero(np.bincount(block.of) == 4000)[0]), at, np.zeros(22000, np.int64), block)
    assert found.shape == (5, 4000) and (found[2] == 0).all() and (found[4] == 10).all()
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_long_items_are_searched_in_parts(docs, benchmark, local, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_WORDS", 700)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(decontaminate, "BLOCKS", 2)
    long = max((r["text"] for r in local if r["text"]), key=len)
    more = [*items, (77, long), (78, "é" * 900)]
    check(find_leaks(docs, docs.sparkSession.createDataFrame(more, "item_id long, text string")), local, more)


def test_a_block_takes_24_bytes_a_word():
    """A megabyte of text of one-letter words is the worst block; one of true words takes less than half of that."""
    for text, most in (("a " * (1 << 19), 14 << 20), (" ".join(f"word{i % 9000}" for i in range(120_000)), 6 << 20)):
        block = decontaminate.Items(["x"], [text], 10)
        sent = sum(v.nbytes for v in vars(block).values() if isinstance(v, np.ndarray))
        assert sent <= 24 * len(block.number) + 8 * len(block.vocabulary) + 1000 and sent < most


def test_a_large_benchmark_takes_bounded_memory():
    """Seventeen megabytes of items, block by block: what is held is one block's work."""
    import resource

    rng = np.random.default_rng(1)
    names = [f"w{i}" for i in range(50_000)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    sent = 0
    for _ in range(17):
        texts = [" ".join(names[i] for i in rng.integers(0, len(names), 150)) for _ in range(1100)]
        block = decontaminate.Items([str(i) for i in range(len(texts))], texts, 10)
        sent += sum(v.nbytes for v in vars(block).values() if isinstance(v, np.ndarray))
    assert sent < 100 << 20
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 << 10
