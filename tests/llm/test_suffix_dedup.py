import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import suffix_dedup
from quarry.llm.suffix_dedup import remove_repeats


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


def brute_words(texts, length):
    """(kept text or None) of each text without the runs of words that stand in strings of length words which start twice."""
    raw = [(t or "").encode() for t in texts]
    at = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", b)] for b in raw]
    named = [[b[s:e] for s, e in spans] for b, spans in zip(raw, at, strict=True)]
    count = Counter(tuple(w[i : i + length]) for w in named for i in range(len(w) - length + 1))
    out = []
    for t, b, spans, w in zip(texts, raw, at, named, strict=True):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = True
        bytes_gone = np.zeros(len(b), bool)
        for i, (s, e) in enumerate(spans):
            if gone[i]:
                bytes_gone[s : spans[i + 1][0] if i + 1 < len(w) and gone[i + 1] else e] = True
        out.append(None if t is None else bytes(np.frombuffer(b, np.uint8)[~bytes_gone]).decode())
    return out


@pytest.mark.parametrize("length", [50, 20, 7])
def test_same_words_as_brute_force(docs, local, length):
    got = {(str(r["doc_id"]), r["_kept"]) for r in remove_repeats(docs, length, unit="words", with_text=True).collect()}
    assert got == {(str(r["doc_id"]), w) for r, w in zip(local, brute_words([r["text"] for r in local], length), strict=True)}


def test_an_unknown_unit_is_refused(docs):
    with pytest.raises(ValueError):
        remove_repeats(docs, 10, unit="lines")


def test_complementary_thue_morse_words_are_told_apart(spark):
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    texts = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r[0]: tuple(r)[1:] for r in remove_repeats(rows, 1024).collect()} == {i: w[:4] for i, w in enumerate(brute(texts, 1024))}


@pytest.mark.parametrize("length", [400, 60, 61])
def test_same_bytes_as_brute_force(docs, local, length):
    got = remove_repeats(docs, length, keep=("doc_id", "k0", "t", "fp"), with_text=True).collect()
    mine = sorted((str(r["doc_id"]), r["_n_bytes"], r["_n_removed"], r["_n_spans"], r["_kept_sha256"]) for r in got)
    want = brute([r["text"] for r in local], length)
    assert mine == sorted((str(r["doc_id"]), *w[:4]) for r, w in zip(local, want, strict=True))
    texts = {(str(r["doc_id"]), r["_kept"]) for r in got}
    assert texts == {(str(r["doc_id"]), None if r["text"] is None else w[4].decode("utf-8", "ignore")) for r, w in zip(local, want, strict=True)}


def test_periodic_texts_and_overlaps(spark):
    texts = ["abc" * 100, "xyz" + "abc" * 30, "q" * 130, "q" * 59 + "!" + "q" * 61, "".join(chr(33 + (i * i) % 90) for i in range(400))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in remove_repeats(rows, 60).collect()}
    assert got == {i: w[:4] for i, w in enumerate(brute(texts, 60))}


def test_long_texts_are_cut_into_overlapping_segments(spark, monkeypatch):
    rng = np.random.default_rng(2)
    parts = ["".join(map(chr, rng.integers(97, 123, 900))) for _ in range(5)]
    texts = [parts[0] + parts[1] + parts[2] * 2 + parts[3], parts[4] + parts[1][100:700] + parts[4]]
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 512)
    import functools

    monkeypatch.setattr(suffix_dedup, "_segments", functools.partial(suffix_dedup._segments, limit=512))
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        rows, p, a, b, _ = suffix_dedup._ranges(data, np.array([0, len(data)]), 100)
        starts = np.concatenate([np.arange(x, y + 1) for x, y in zip(a, b, strict=True)])
        assert sorted(starts) == list(range(len(data) - 99)) and (p >= a).all() and (p <= b + 50 + 50).all()


def test_lists_without_broadcast(docs, local, monkeypatch):
    from quarry.llm import shared

    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    got = sorted((str(r[0]), *r[1:]) for r in remove_repeats(docs, 60).collect())
    assert got == sorted((str(r["doc_id"]), *w[:4]) for r, w in zip(local, brute([r["text"] for r in local], 60), strict=True))


def test_empty_table(empty):
    assert remove_repeats(empty).collect() == []


def passage_words(texts, length):
    """Words of each text that stand in strings of length words which start twice."""
    named = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()) for t in texts]
    count = Counter(tuple(w[i : i + length]) for w in named for i in range(len(w) - length + 1))
    return [len({j for i in range(len(w) - length + 1) if count[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}) for w in named]


@pytest.mark.parametrize("passages", [20, 7])
def test_passage_words_beside_removed_bytes(docs, local, passages):
    got = sorted((str(r["doc_id"]), r["_n_removed"], r["_kept_sha256"], r["_n_passage_words"]) for r in remove_repeats(docs, 60, passages=passages).collect())
    texts = [r["text"] for r in local]
    assert got == sorted((str(r["doc_id"]), w[1], w[3], n) for r, w, n in zip(local, brute(texts, 60), passage_words(texts, passages), strict=True))
    assert any(g[3] for g in got)


def test_query_tells_passages_of_50_words_shorter_than_400_bytes(spark, tmp_path):
    from quarry.llm.queries import op9_suffix_array_dedup

    passage = " ".join(f"p{i}" for i in range(55))
    texts = [f"one {passage} two", f"three {passage}", "alone " + " ".join(f"w{i}" for i in range(80)), "copy", "copy", None, "", " ".join(f"c{i}" for i in range(120)), " ".join(f"c{i}" for i in range(120))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in op9_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert len(passage) < 400
    assert got == {i: (*w[:4], n) for i, (w, n) in enumerate(zip(brute(texts, 400), passage_words(texts, 50), strict=True))}
    assert [got[i][4] for i in range(9)] == [55, 55, 0, 0, 0, 0, 0, 120, 120]


@pytest.mark.parametrize("values", ["bytes", "numbers"])
def test_equal_runs_have_one_hash_wherever_they_stand(values):
    from quarry.llm.numeric import run_hashes

    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 3000).astype(np.uint8) if values == "bytes" else rng.integers(0, 1 << 61, 3000).astype(np.uint64)
    data[2000:2300] = data[5:305]
    names = run_hashes(data, 40)
    assert len(names) == 2961 and (names[2000:2261] == names[5:266]).all() and len(set(names.tolist())) == 2700


def test_ranges_end_with_anchors_and_rows():
    rng = np.random.default_rng(4)
    sizes = [130, 0, 99, 100, 101, 3, 500, 0]
    data, offsets = rng.integers(97, 100, sum(sizes)).astype(np.uint8), np.concatenate([[0], np.cumsum(sizes)])
    rows, p, a, b, _ = suffix_dedup._ranges(data, offsets, 100)
    starts = sorted((r, s) for r, x, y in zip(rows.tolist(), a.tolist(), b.tolist(), strict=True) for s in range(x, y + 1))
    assert starts == [(r, s) for r, n in enumerate(sizes) for s in range(n - 99)] and (p >= b).all() and (p <= a + 50).all()
