import math
import os
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import language, quality
from quarry.llm.sampling import held_out

NAMES = {"en": ["the", "and", "with", "that", "this", "from"], "fr": ["les", "dans", "être", "été", "pour", "avec"], "de": ["und", "nicht", "für", "über", "eine", "ist"]}


def sentence(rng, lang, n):
    return " ".join(rng.choice(NAMES[lang]) + rng.choice(["", "en", "er", "s"]) for _ in range(n))


def fold(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(400):
        lang = rng.choice(list(NAMES))
        good = rng.random() < 0.7
        text = sentence(rng, lang, rng.randrange(8, 60))
        rows.append((i, text if good else " | ".join(text.upper().split()), lang, "s", 1))
        marks.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), rows, marks


def test_folds_follow_crc32(spark):
    got = {r[0]: r[1] for r in spark.range(50).select("id", held_out(F.col("id"))).collect()}
    assert got == {i: fold(i) for i in range(50)}


def test_quality_on_held_out_rows(labelled):
    docs, labels, _, marks = labelled
    out = {r["doc_id"]: r for r in quality.with_fold(quality.score_quality(docs, quality.fit(docs, labels))).collect()}
    assert len(out) == 400 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == fold(r["doc_id"]) for r in out.values())
    test = [(out[i]["predicted"], q) for i, q, _ in marks if fold(i)]
    assert np.mean([a == b for a, b in test]) > 0.97


def test_quality_ignores_held_out_labels(spark, labelled):
    docs, labels, _, marks = labelled
    turned = spark.createDataFrame([(i, 1 - q if fold(i) else q, 0) for i, q, _ in marks], "doc_id long, quality int, toxic int")
    score = lambda m: sorted(quality.score_quality(docs, m).collect())
    assert score(quality.fit(docs, labels)) == score(quality.fit(docs, turned))


def test_scores_keep_the_class_shares_of_all_labels_when_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "the same words for all") for i in range(800)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(800)], "doc_id long, quality int, toxic int")
    learned = [int(i % 7 > 0) for i in range(800) if not fold(i)]
    for fit_rows in (10_000, 40):
        out = quality.with_fold(quality.score_quality(docs, quality.fit(docs, labels, fit_rows))).collect()
        assert {r["predicted"] for r in out} == {1} and all(abs(r["score"] - np.mean(learned)) < 0.01 for r in out)


def test_class_weights():
    assert quality.class_weights(np.array([0, 1, 1]), np.array([1.0, 2.0, 2.0])).tolist() == [1, 1, 1]
    w = quality.class_weights(np.array([0, 0, 1, 1]), np.array([10.0, 10.0, 90.0, 90.0]))
    assert np.allclose(w, [0.2, 0.2, 1.8, 1.8])


def test_forest_scores_like_a_walk_of_each_tree():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, len(quality.STATISTICS)))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float)
    f = quality.Forest(x, y)
    assert ((f.score(x) > 0.5) == y).mean() > 0.9
    for row, got in zip(x[:20], f.score(x[:20]), strict=True):
        margin = f.base
        for t in range(quality.TREES):
            at = 0
            for _ in range(quality.DEPTH):
                at = 2 * at + 1 + int(row[f.feature[t, at]] > f.threshold[t, at])
            margin += f.leaf[t, at - (2**quality.DEPTH - 1)]
        assert abs(1 / (1 + np.exp(-margin)) - got) < 1e-9


def test_quality_edge_cases(spark, docs, empty, local):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(local[0]["doc_id"], None, 0), (None, 1, 0), (10**9, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        out = quality.score_quality(docs, quality.fit(docs, labels), keep=("doc_id", "text", "k0", "t", "_score", "a.b")).collect()
        assert len(out) == len(local) and all(abs(r["_score"] - 0.5) < 1e-9 for r in out) and out[0].asDict().keys() == {"doc_id", "text", "k0", "t", "a.b", "_score"}
    assert quality.score_quality(empty, quality.fit(empty, none)).collect() == []


def test_language_on_held_out_rows(labelled):
    docs, _, rows, _ = labelled
    out = {r["doc_id"]: r for r in language.with_fold(language.identify(docs, language.fit(docs))).collect()}
    assert np.mean([out[i]["lang_pred"] == lang for i, _, lang, *_ in rows if fold(i)]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["held_out"] == fold(r["doc_id"]) for r in out.values())


@pytest.mark.parametrize("k", [2, 3, 5, 9, 30])
def test_codewords_are_apart(k):
    code = language.codewords(k)
    assert code.shape[0] == k and set(np.unique(code)) <= {-1.0, 1.0}
    apart = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
    assert min(apart) >= (1 if k < 4 else 3)


def test_language_edge_cases(spark, docs, empty, local):
    codes = language.fit(docs)
    out = language.identify(docs, codes, keep=("doc_id", "text", "t")).collect()
    assert len(out) == len(local)
    for r in out:
        silent = r["text"] is None or not any(c.isalpha() for c in r["text"])
        assert (r["_lang"] == "und") == silent and (not silent or r["_score"] == 0)
    nothing = language.fit(empty)
    assert {r["_lang"] for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(empty, codes).collect() == []
    one = spark.createDataFrame([(i, "abc def", "xx") for i in range(9)], "doc_id long, text string, lang string")
    assert {r["_lang"] for r in language.identify(one, language.fit(one)).collect()} == {"xx"}


def test_many_languages_leave_the_driver_flat(spark):
    """With 40 languages the driver holds the sums of the equations, not the documents' features."""
    import tracemalloc

    rng = np.random.default_rng(4)
    letters = [[chr(97 + i) for i in rng.permutation(26)[:8]] for _ in range(40)]
    rows = [(i, " ".join("".join(rng.choice(letters[i % 40], 5)) for _ in range(40)), f"l{i % 40:02}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tracemalloc.start()
    codes = language.fit(docs)
    assert tracemalloc.get_traced_memory()[1] < 250 << 20
    tracemalloc.stop()
    out = {r["doc_id"]: r["lang_pred"] for r in language.with_fold(language.identify(docs, codes)).collect()}
    assert np.mean([out[i] == lang for i, _, lang in rows if fold(i)]) > 0.9


def plain_ngrams(text):
    """Square roots of shares of hashed letter pairs and triples, one character code after the other."""
    low = [b + 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in text.encode()]
    out = [0.0] * language.WIDTH
    for size in (2, 3):
        for i in range(len(low) - size + 1):
            if low[i] == low[i + 1] == 0x20:
                continue
            code = 0
            for c in low[i : i + size]:
                code = (code << 8 | c) & 0xFFFFFFFF
            out[((code * 2654435761 + size * 40503) & 0xFFFFFFFF) >> 21] += 1
    total = max(1.0, sum(out))
    return [math.sqrt(x / total) for x in out]


def plain_decode(codes, text):
    """The language of least loss by a loop over codewords and bits."""
    x = plain_ngrams(text)
    bits = len(codes.code[0])
    said = [min(3.0, max(-3.0, sum(x[f] * codes.weights[f][b] for f in range(language.WIDTH) if x[f]) + codes.weights[-1][b])) for b in range(bits)]
    loss = [sum(codes.trust[c][b] * math.exp(-2 * codes.code[c][b] * said[b]) for b in range(bits)) for c in range(len(codes.languages))]
    best = min(range(len(loss)), key=lambda c: (loss[c], c))
    share = [math.exp(-4 * (v - loss[best])) for v in loss]
    two = sorted(loss)[:2]
    return codes.languages[best], max(share) / sum(share), two[1] - two[0] < language.AMBIGUOUS * two[1]


@pytest.mark.parametrize("k", [2, 4, 9])
def test_decoding_equals_a_loop_over_codewords(k):
    rng = np.random.default_rng(k)
    languages = [f"l{i}" for i in range(k)]
    bits = language.codewords(k).shape[1]
    codes = language.Codes(languages, rng.normal(size=(language.WIDTH + 1, bits)) * 3).trusted(rng.random((k, bits)))
    texts = ["", "a", "The cat, the hat!", "été à la plage", "x" * 300, "123 456", "日本語 テキスト", *(" ".join(rng.choice(["und", "les", "with", "niño"], 12)) for _ in range(6))]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    best, score, doubt = codes.decode(language.ngrams(data, offsets))
    for t, b, s, d in zip(texts, best, score, doubt, strict=True):
        name, share, ambiguous = plain_decode(codes, t)
        assert (languages[b], bool(d)) == (name, ambiguous) and abs(s - share) < 1e-9, t


SMALL_RESULTS = """
import random
from pyspark.sql import SparkSession
from quarry.llm import language

spark = SparkSession.builder.master("local[2]").config("spark.driver.maxResultSize", "2m").config("spark.sql.shuffle.partitions", "4").config("spark.sql.adaptive.enabled", "false").config("spark.ui.enabled", "false").getOrCreate()
rng = random.Random(5)
rows = [(i, " ".join(rng.choice("xyz" if i % 2 else "abc") for _ in range(40)), "x" if i % 2 else "a") for i in range(200)]
docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
out = language.identify(docs, language.fit(docs)).join(docs, "doc_id")
assert out.count() == 200 and out.filter("_lang <> lang").count() == 0
spark.stop()
"""


def test_language_fit_sends_no_feature_matrix_to_the_driver():
    """Sums of four tasks, and a driver that takes 2 MB of results at most: one task's sums of the equations are 17 MB."""
    run = subprocess.run([sys.executable, "-c", SMALL_RESULTS], env=os.environ | {"PYTHONPATH": str(Path(language.__file__).parents[2])}, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
