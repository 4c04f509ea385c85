import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import packing, queries, spelling, vector_codes

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="session")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return packing.Encoder(f.read())


ODD = [
    "", " ", "  ", "\n", "a", " a", "a ", "  a  b ", "a\n b", "a \n b\t\tc  ", "don't can't we'll I'M 'S x's", "1 2 3 12345 1a2b", "¡hola! ¿qué tal? ñandú — “quoted” …", "x y  z", "a b  c", "日本語 テキスト です", "emoji 😀😀 👩‍👩‍👧 done",
    "<|endoftext|> and text<|endoftext|>", "a\x1cb \x1fc\x85d", "é" * 500, "ab" * 7000, "word " * 500, "ѐ ѓ Ѣ҃ ԓ", "﻿bom", "tab\tsep\r\nline", "ǅ ʰ ª º ² ½", "a" * 120_000,
]


@pytest.mark.parametrize("text", ODD)
def test_ids_are_those_of_the_tokenizer(encoder, tokenizer, text):
    assert np.frombuffer(encoder(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([" ", "  ", "\n", " \n", "'s", "1", "12", "é", "ß", " ", "word", "Word", "—", "!", "?!", "<|endoftext|>"]), st.text(max_size=4)), max_size=30))
def test_ids_of_any_text(parts):
    tokenizer = _cache("tokenizer", lambda: Tokenizer.from_file(PATH))
    tokenizer.encode_special_tokens = True
    encoder = _cache("encoder", lambda: packing.Encoder(open(PATH, encoding="utf-8").read()))
    text = "".join(parts).encode("utf-8", "ignore").decode()
    assert np.frombuffer(encoder(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_chunks_that_were_not_seen_are_encoded_together(encoder, tokenizer, monkeypatch):
    calls, encode = [], packing.Encoder.encode
    monkeypatch.setattr(packing.Encoder, "encode", lambda self, text: calls.append(len(text)) or encode(self, text))
    text = " ".join(f"Word{i}x ñ{i}, 日{i % 7}  \n" for i in range(4000))
    assert np.frombuffer(encoder(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(calls) < 12 and max(calls) < 100_000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("  \n\tab!~\x7f\x80\xa0\xa1\xadéΏЀԯ\u0530日😀\x1f"), max_size=12), max_size=8))
def test_ids_of_rows_side_by_side(texts):
    encoder = _cache("encoder", lambda: packing.Encoder(open(PATH, encoding="utf-8").read()))
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    places = [int(a) + len(t[: m.start()].encode()) for a, t in zip(offsets, texts, strict=False) for m in re.finditer("(?=[ ][!-~\xa1-\u052f])", t)]
    assert packing._cuts(data, offsets).tolist() == places
    if texts:
        ids, ends = encoder.many(data, offsets)
        assert [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == list(map(encoder, texts))


_CACHE: dict = {}


def _cache(name, make):
    if name not in _CACHE:
        _CACHE[name] = make()
    return _CACHE[name]


def test_first_fit_finds_the_first_bin():
    rng = random.Random(5)
    for capacity, n in ((10, 1), (16, 3), (1024, 200)):
        bins, plain = packing.Bins(capacity, n), []
        for _ in range(n):
            size = rng.randrange(1, capacity + 1)
            at = next((i for i, room in enumerate(plain) if room >= size), len(plain))
            plain += [capacity] * (at == len(plain))
            plain[at] -= size
            assert bins.put(size) == at


@pytest.mark.parametrize("seed", range(6))
def test_lengths_are_packed_whole_with_little_room(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 360, 700, 1023, 1024, 1025, 2048, 5000, rng.randrange(1, 1500)]) for _ in range(rng.choice([1, 2, 40, 400]))]
    pieces = packing.pack_lengths(lengths, 1024)
    held, placed = defaultdict(list), defaultdict(list)
    for d, start, size, sequence, offset in pieces:
        assert 0 < size <= 1024
        placed[d].append((start, size))
        held[sequence].append((offset, size))
    for d, size in enumerate(lengths):
        at = 0
        for start, n in sorted(placed[d]):
            assert start == at
            at += n
        assert at == size
    for own in held.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    wide = [1024 - sum(n for _, n in own) for own in held.values()]
    assert sum(room * packing.OPEN_SHARE > 1024 for room in wide) <= 1
    assert len(held) <= math.ceil(sum(lengths) / 1024 * 64 / 63) + 1


def packed_rows(df, tokenizer, texts_by_row):
    """Checks the pieces of rows (key, text) and gives how many tokens there are by key."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in df:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.row].append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    for key, text in texts_by_row.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(by_doc.pop(key), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, len(r.ids) // 4) == (at, len(ids), r.length)
            assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids[at : at + r.length]
            at += r.length
        assert at == len(ids)
    assert not by_doc
    return len(by_sequence)


@pytest.mark.parametrize("group", [7, 1000])
def test_every_id_is_in_one_piece(spark, docs, local, tokenizer, group):
    # rows are told apart by a name of their own, as ids repeat and are null
    rows = [(*(v for k, v in d.items() if k != "row"), str(i)) for i, d in enumerate(local)]
    names = [k for k in local[0] if k != "row"] + ["row"]
    kinds = dict(zip([f.name for f in docs.schema], [f.dataType.simpleString() for f in docs.schema], strict=True))
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {kinds[n]}" for n in names)).repartition(3)
    got = packing.pack(df, PATH, keep=("doc_id", "row", "a.b", "t"), group_docs=group).collect()
    assert {r["a.b"] for r in got} == {4, None}
    packed_rows(got, tokenizer, {str(i): d["text"] for i, d in enumerate(local)})


def test_hot_rows_go_to_many_groups_and_runs_repeat(spark, tokenizer):
    rows = [(None, None if i % 2 else "same text") for i in range(600)] + [(i, " ".join(f"w{(i * k) % 97}" for k in range(30))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "text")
    got = packing.pack(df, PATH, group_docs=50)
    first, again = (sorted((r.doc_id or -1, r.start, r.length, r.sequence_id, r.offset) for r in got.collect()) for _ in range(2))
    assert first == again and len(first) >= 660
    sizes = Counter(r[3] >> 32 for r in first)
    assert max(sizes.values()) < 200


def test_packing_of_nothing(empty):
    assert packing.pack(empty, PATH).collect() == []
    assert packing.pack(empty, PATH).columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def test_query_packs_the_given_table(spark, tokenizer):
    path = "/root/testdata/sf0.001"
    got = queries.op11_sequence_packing(spark, path).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    assert by_doc.keys() == texts.keys()
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for r in by_doc[i]:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
        assert sum(r.length for r in by_doc[i]) == len(ids)
    tokens = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= math.ceil(tokens / 1024 * 1.02)


VECTORS = "vec_id long, embedding array<double>, label int, v int, id string, code string"


def vectors(n=150, d=32, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(size=d)], int(rng.integers(3)) or None) for i in rng.permutation(n)]
    rows += [(1000, None, 1), (1001, [math.nan] + [0.0] * (d - 1), 1), (1002, [math.inf] * d, 2), (1003, [None] + [1.0] * (d - 1), None), (None, [0.5] * d, 2), (3, rows[9][1], 1), rows[0], (1004, [1.0] * (d // 2), 1), (1005, [], None), (1006, [-0.001, 1e3] * (d // 2), 77)]
    return rows


def plain_codes(rows, parts, entries, rounds, d):
    """The codes by loops over Python integers."""
    whole = [(i, [math.floor(256 * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fit = [(i, v, g) for i, v, g in whole if len(v) == d]
    start = {}
    for i, v, _ in fit:
        if i is not None:
            start[i] = min(start.get(i, v), v)
    size = d // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(start[i], p) for i in sorted(start)[:entries]] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    best = lambda v, p: min((far(cut(v, p), c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        held = [defaultdict(list) for _ in range(parts)]
        for _, v, _ in fit:
            for p in range(parts):
                held[p][best(v, p)[1]].append(cut(v, p))
        books = [[[sum(c) // len(held[p][k]) for c in zip(*held[p][k], strict=True)] if held[p][k] else old for k, old in enumerate(books[p])] for p in range(parts)]
    out = [(i, *(("".join(f"{best(v, p)[1]:02x}" for p in range(parts)), sum(best(v, p)[0] for p in range(parts))) if len(v) == d else (None, None)), g) for i, v, g in whole]
    total = defaultdict(int)
    for _, _, e, g in out:
        total[g] += e or 0
    return sorted(((i, c, e, total[g]) for i, c, e, g in out), key=repr), books


@pytest.mark.parametrize(("parts", "entries", "rounds", "block"), [(16, 64, 2, 4096), (4, 5, 3, 7), (8, 200, 1, 16), (2, 1, 0, 64)])
def test_codes_are_those_of_plain_loops(spark, monkeypatch, parts, entries, rounds, block):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", block)
    rows = vectors()
    df = spark.createDataFrame([(i, v, g, 1, "x", "y") for i, v, g in rows], VECTORS).repartition(5)
    want, books = plain_codes(rows, parts, entries, rounds, 32)
    got = vector_codes.encode(df, parts, entries, rounds).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == want
    assert vector_codes.fit(df, parts, entries, rounds).tolist() == books
    assert {r.codebooks_sha256 for r in got} == {vector_codes._digest(np.array(books))}


def test_codes_without_vectors_or_out_of_bounds(spark):
    df = spark.createDataFrame([], VECTORS)
    assert vector_codes.encode(df).collect() == []
    only = spark.createDataFrame([(None, [1.0] * 16, 3, 1, "x", "y"), (1, None, 3, 1, "x", "y")], VECTORS)
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.encode(only).collect()] == [(None, None, None, None)]
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.fit(spark.createDataFrame([(1, [1.0] * 15, 3, 1, "x", "y")], VECTORS))
    with pytest.raises(Exception, match="beyond"):
        vector_codes.encode(spark.createDataFrame([(1, [1e9] * 16, 3, 1, "x", "y")], VECTORS)).collect()


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("letters", ["ab", "abcé", "abcdefgh"])
def test_automaton_numbers_words_and_finds_one_error(letters):
    rng = random.Random(len(letters))
    for _ in range(60):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(1, 80))})
        automaton = spelling.Automaton(words)
        for number, word in enumerate(words):
            state, found = automaton.walk(0, 0, word)
            assert automaton.final[state] and found == number
            for exact in range(len(word)):
                got = automaton.near(word, exact, True, True, True)
                assert sorted(got) == [i for i, w in enumerate(words) if near(word, w) and w[:exact] == word[:exact]]


def test_automaton_is_minimal():
    automaton = spelling.Automaton(sorted(a + b + c for a in "abc" for b in "xy" for c in ("", "s", "ing")))
    # one state for each of: start, one letter, two letters, -s and -ing ends, -i, -in
    assert len({s for s in _reached(automaton)}) == 6


def _reached(automaton):
    seen, stack = set(), [0]
    while stack:
        state = stack.pop()
        if state not in seen:
            seen.add(state)
            stack += [to for to, _ in automaton.arcs[state].values()]
    return seen


def plain_variants(rows, least, every=31):
    import re

    counts = Counter()
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if k >= 2 and len(w) >= least}
    form, many = {}, {}
    for w in n:
        close = [v for v in n if near(v, w)]
        many[w] = len(close)
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], many[w], n.get(form[w])))
    return sorted(out)


@pytest.mark.parametrize(("group", "least"), [(20_000, 7), (6, 7), (1, 3), (3, 1)])
def test_variants_equal_all_pairs(spark, group, least):
    """Small groups make halves be dealt again and again."""
    rng = random.Random(group)
    stems = ["".join(rng.choice("abé") for _ in range(rng.choice([least, least + 1, 9, 12]))) for _ in range(25)]
    rows = []
    for i in range(260):
        words = []
        for _ in range(30):
            w = stems[min(int(rng.expovariate(0.4)), 24)]
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "b", "éa"]) + w[at + rng.randrange(2) :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i // 2 if i % 7 else None, rng.choice([" ", "-", "3", "."]).join(words)))
    rows += [(5, None), (6, ""), (7, "ÀÉ×÷ÿÀÉ×÷ÿ ÀÉ×÷ÿÀÉ×÷ÿ àé ŁódźŁódźŁódź"), (8, "a" * 3000 + " " + "a" * 2999 + " " + "a" * 3000 + " " + "a" * 2999)]
    df = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], "doc_id long, text string, word string, n int, size int").repartition(4)
    got = spelling.variants(df, least=least, group_words=group)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(rows, least)
    assert sum(r[1] is not None for r in want) > 3 and sum(r[1] is not None and r[2] != r[1] for r in want) + (group > 1) > 0
    assert sorted(tuple(r) for r in got.collect()) == want


def test_roots_follow_long_chains(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)], "word string, form string")
    assert {(r.word, r.root) for r in spelling.follow(links).collect()} == {(f"w{i}", "w37") for i in range(37)}


def test_variants_of_nothing(empty):
    assert spelling.variants(empty).collect() == []
    assert spelling.variants(empty.withColumn("text", F.lit(None).cast("string"))).collect() == []
