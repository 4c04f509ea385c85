import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import components, jaccard_join
from quarry.llm.jaccard_join import near_duplicates, region_links


def shingles(text, n):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute(rows, n, percent):
    sets = [(r["doc_id"], shingles(r["text"], n)) for r in rows if r["doc_id"] is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    has = defaultdict(list)
    for at, (_, s) in enumerate(sets):
        shared = Counter(j for g in s for j in has[g])
        for j, o in shared.items():
            if 100 * o >= percent * (len(s) + len(sets[j][1]) - o):
                a, b = find(sets[at][0]), find(sets[j][0])
                root[max(a, b)] = min(a, b)
        for g in s:
            has[g].append(at)
    return {(i, len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_same_groups_as_brute_force(docs, local, n, percent):
    got = near_duplicates(docs, n, percent).collect()
    assert len(got) == len(local)
    assert {tuple(r) for r in got if r["doc_id"] is not None} == brute(local, n, percent)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


@pytest.mark.parametrize(("pivots", "more"), [(3, 1), (8, 2), (1, 4)])
def test_large_regions_are_cut_and_joined_in_blocks(docs, local, monkeypatch, pivots, more):
    monkeypatch.setattr(jaccard_join, "REGION_ROWS", 4)
    monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard_join, "MORE_PIVOTS", more)
    monkeypatch.setattr(jaccard_join, "SHARE_ROWS", 3)
    assert {tuple(r) for r in near_duplicates(docs, 3, 90).collect() if r["doc_id"] is not None} == brute(local, 3, 90)


def test_a_copy_without_id_takes_no_links_away(spark):
    words = [f"w{i}" for i in range(200)]
    near = " ".join([*words[:-1], "other"])
    rows = [(None, " ".join(words)), (5, " ".join(words)), (7, near)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 5, 80).collect()
    assert {(r["doc_id"], r["component_id"]) for r in out} == {(None, None), (5, 5), (7, 5)}


def test_complementary_thue_morse_words_are_told_apart(spark):
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    rows = [(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits)), (3, "".join("ab"[b] for b in bits))]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {(r["doc_id"], r["component_id"]) for r in out} == {(1, 1), (2, 2), (3, 1)}


@pytest.mark.parametrize("heavy", [3, 512])
def test_regions_are_cut_by_their_rarest_shingles(spark, monkeypatch, heavy):
    rng = random.Random(4)
    lines = [" ".join(f"l{i}x{k}" for k in range(12)) for i in range(12)]
    own = lambda n: " ".join(f"o{rng.randrange(10**9)}" for _ in range(n))
    texts = [" ".join([*rng.sample(lines, 6), own(rng.randrange(2, 30))]) for _ in range(120)]
    texts += [t[: t.rindex(" ")] for t in texts[:40]] + [" ".join(rng.sample(lines, 5)) for _ in range(40)]
    rows = [{"doc_id": i, "text": t} for i, t in enumerate(texts)]
    monkeypatch.setattr(jaccard_join, "REGION_ROWS", 20)
    monkeypatch.setattr(jaccard_join, "HEAVY", heavy)
    monkeypatch.setattr(jaccard_join, "CHAIN_ROWS", 3)
    seen = []
    rarest = jaccard_join._rarest
    monkeypatch.setattr(jaccard_join, "_rarest", lambda *a: seen.append(1) or rarest(*a))
    got = near_duplicates(spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string"), 5, 80).collect()
    assert {tuple(r) for r in got} == brute(rows, 5, 80) and seen


def repeated(rows, n, percent):
    """Components of rows (id, text), all sets of an id being one document."""
    sets = []
    for i, t in rows:
        w = (t or "").split()
        sets.append((i, {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()))
    own = {i: i for i, _ in sets}

    def find(i):
        while own[i] != i:
            i = own[i]
        return i

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                own[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def test_sets_of_one_id_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a), (5, a + " z"), (5, b), (7, b + " y"), (5, ""), (9, None), (9, "c d e f g h"), (11, "")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted(tuple(r) for r in got) == repeated(rows, 3, 90)
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 5, 7)} == {3}


def test_repeated_ids_against_all_pairs(spark):
    rng = random.Random(8)
    base = [[f"{c}{i}" for i in range(50)] for c in "abcdefgh"]
    rows = []
    for _ in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(50)] = f"x{rng.randrange(10**6)}"
        rows.append((rng.randrange(40), " ".join(w if rng.random() < 0.5 else w + [f"y{rng.randrange(10**6)}" for _ in range(40)])))
    rows += [(1, None), (2, ""), (99, "")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 90).collect()
    assert sorted(tuple(r) for r in got) == repeated(rows, 3, 90)


def test_empty_table(empty):
    assert near_duplicates(empty, 3, 90).collect() == []


def test_region_links_find_every_connection():
    rng = np.random.default_rng(5)
    for _ in range(30):
        base = rng.choice(1000, 40, replace=False)
        sets = []
        for _ in range(25):
            s = base.copy()
            k = rng.integers(0, 8)
            s[rng.choice(40, k, replace=False)] = rng.integers(1000, 2000, k)
            sets.append(np.unique(s).astype(np.uint64))
        sizes = np.array([len(s) for s in sets])
        roots = region_links(np.concatenate(sets), sizes, 80)
        own = list(range(25))

        def find(i):
            while own[i] != i:
                i = own[i]
            return i

        for i in range(25):
            for j in range(i):
                o = len(np.intersect1d(sets[i], sets[j]))
                if 100 * o >= 80 * (sizes[i] + sizes[j] - o):
                    a, b = find(i), find(j)
                    own[max(a, b)] = min(a, b)
        assert [int(r) for r in roots] == [find(i) for i in range(25)]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {tuple(r) for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 150)} | {(i, 200) for i in range(200, 203)}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []
