import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k0 string, t int, fp long, row string, leaf int, _score double, `a.b` int"


def document(rng, words, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, very short, empty, very long and null ones, and non-ASCII letters."""
    rng = random.Random(7)
    texts = [document(rng, rng.choice([3, 30, 120, 300])) for _ in range(60)]
    passage = document(rng, 90)
    for i in range(8):
        texts.append(document(rng, 20 + i) + " " + passage + " " + document(rng, 15))
    base = document(rng, 200).split()
    for i in range(12):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(copy))
    texts += [texts[0], texts[0], texts[3], "", " \n\t", None, "Ein", "zwei Wörter", "UPPER Case Words here", "é" * 500, "ab" * 700, document(rng, 12000, 5000), "日本語 テキスト です"]
    texts += [document(rng, 40) + "é" + passage, passage, "x " * 450]
    return texts


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with ids in no order, nulls in every column, a repeated row, a null id, and columns whose names the operators use inside."""
    rng = random.Random(3)
    ids = rng.sample(range(1000), len(corpus))
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["src0", "src0", "src1", "odd", None]), None if t is None else len(t), "k", 1, 2, "r", 3, 0.5, 4) for i, t in zip(ids, corpus, strict=True)]
    rows += [rows[5], (None, "no id here at all", None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def local(docs):
    return [r.asDict() for r in docs.collect()]
