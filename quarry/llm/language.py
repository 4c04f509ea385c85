"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier over letter n-grams predicts each bit, and decoding picks the
codeword with the least weighted loss, where a bit weighs for a language as much as its classifier is right on it.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numeric import text_slices
from .sampling import held_out, learning_rows
from .shared import Carried, cut, kept_arrays

#: Documents of each language that a model is fitted on at most.
FIT_ROWS = 1500
#: Hashed n-gram features; up to so many classes have all possible bits.
WIDTH, EXHAUSTIVE = 2048, 7
#: Rows whose features are held at once; tasks of a fit.
ROWS, FIT_TASKS = 512, 8
#: A text is ambiguous if the second-best loss is within this share of the best.
AMBIGUOUS = 0.15
UNKNOWN = "und"

LETTER = np.arange(256, dtype=np.uint8)
LETTER[0x41:0x5B] += 0x20
LETTER[:0x41] = LETTER[0x5B:0x61] = LETTER[0x7B:0x80] = 0x20


def ngrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed letter pairs and triples of each text; anything but letters counts as a space."""
    n = len(offsets) - 1
    out = np.zeros((n, WIDTH))
    if len(data) < 2:
        return out
    low = LETTER[data].astype(np.uint32)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    blank = low == 0x20
    for size in (2, 3):
        m = len(low) - size + 1
        if m <= 0:
            continue
        code = low[:m].copy()
        for j in range(1, size):
            code = code << np.uint32(8) | low[j : j + m]
        code = (code * np.uint32(2654435761) + np.uint32(size * 40503)) >> np.uint32(21)
        fine = (rows[:m] == rows[size - 1 :]) & ~(blank[:m] & blank[1 : m + 1])
        out += np.bincount(rows[:m][fine] * WIDTH + code[fine], minlength=n * WIDTH).reshape(n, WIDTH)
    total = out.sum(1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def codewords(k: int) -> np.ndarray:
    """k codewords of -1 and 1: all different bits for a few classes, else the best of seeded random codes."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= EXHAUSTIVE:
        bits = np.arange((1 << (k - 1)) - 1)
        rest = (bits[None, :] >> np.arange(k - 1)[:, None]) & 1
        return np.vstack([np.ones(len(bits)), np.where(rest, 1.0, -1.0)])
    n, best, found = int(np.ceil(15 * np.log2(k))), -1, None
    for seed in range(50):
        code = np.where(np.random.default_rng(seed).random((k, n)) < 0.5, -1.0, 1.0)
        if (np.abs(code.sum(0)) == k).any():
            continue
        apart = ((n - code @ code.T) / 2 + n * np.eye(k)).min()
        if apart > best:
            best, found = apart, code
    return found


class Codes:
    """The languages, their codewords, a ridge classifier per bit and the weight of each bit for each language."""

    def __init__(self, languages: list[str], weights: np.ndarray | None = None):
        self.languages = languages
        self.code = codewords(len(languages))
        self.weights = np.zeros((WIDTH + 1, self.code.shape[1])) if weights is None else weights
        self.trust = np.full(self.code.shape, 1 / max(1, self.code.shape[1]))

    def trusted(self, right: np.ndarray) -> Codes:
        """With weights of bits by how many learned documents of each language a bit is right for."""
        self.trust = right / np.maximum(right.sum(1, keepdims=True), 1e-12)
        return self

    def decode(self, x: np.ndarray):
        """(class, score, ambiguous): the codeword of least weighted loss and its share among all."""
        said = np.clip(x @ self.weights[:-1] + self.weights[-1], -3, 3)
        loss = np.stack([(self.trust[c] * np.exp(-2 * self.code[c] * said)).sum(1) for c in range(len(self.languages))], axis=1)
        best = loss.argmin(1)
        weight = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        score = weight.max(1) / weight.sum(1)
        if loss.shape[1] < 2:
            return best, score, np.zeros(len(x), bool)
        two = np.partition(loss, 1, axis=1)[:, :2]
        return best, score, two[:, 1] - two[:, 0] < AMBIGUOUS * two[:, 1]


def _features(batches):
    """(rows, features and a 1) of each slice."""
    for part, data, offsets in text_slices(batches, "text"):
        for at in range(0, part.num_rows, ROWS):
            end = min(at + ROWS, part.num_rows)
            x = ngrams(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            yield part.slice(at, end - at), np.hstack([x, np.ones((len(x), 1))])


def _equations(batches, share: dict[str, float], languages: list[str], code: np.ndarray):
    """The sums of the normal equations of one task: the upper half of features by features, then features by bits."""
    left = right = None
    for own, x in _features(batches):
        names = own.column(own.schema.get_field_index("y")).to_pylist()
        weighted = (x * np.array([share[y] for y in names])[:, None]).T
        a, b = weighted @ x, weighted @ code[np.searchsorted(languages, names)]
        left, right = (a, b) if left is None else (left + a, right + b)
    if left is not None:
        sums = np.concatenate([left[np.triu_indices(WIDTH + 1)], right.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])


def _right(batches, model):
    """How often each bit is right for the documents of each language in one task."""
    codes = model.value
    total = np.zeros(codes.code.shape)
    for own, x in _features(batches):
        y = np.searchsorted(codes.languages, own.column(own.schema.get_field_index("y")).to_pylist())
        np.add.at(total, y, np.sign(x @ codes.weights) == codes.code[y])
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["right"])


ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[0x41:0x5B] = ASCII_LETTER[0x61:0x7B] = True


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    found = np.bincount(rows[ASCII_LETTER[data]], minlength=len(offsets) - 1) > 0
    for row in np.flatnonzero(~found & (np.bincount(rows[data >= 0x80], minlength=len(found)) > 0)):
        found[row] = any(c.isalpha() for c in data[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "ignore"))
    return found


def _predict(batches, text: str, codes):
    model = codes.value
    names = np.array([*model.languages, UNKNOWN], object)
    for part, data, offsets in text_slices(batches, text):
        for at in range(0, part.num_rows, ROWS):
            end = min(at + ROWS, part.num_rows)
            d, o = data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            best, score, doubt = np.full(end - at, -1), np.zeros(end - at), np.ones(end - at, bool)
            if model.languages:
                best, score, doubt = model.decode(ngrams(d, o))
            silent = ~_has_letter(d, o)
            best, score = np.where(silent, -1, best), np.where(silent, 0.0, score)
            own = part.slice(at, end - at)
            kept, arrays = kept_arrays(own)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(names[best], pa.string()), pa.array(score), pa.array(doubt | silent)], [*kept, "lang", "score", "ambiguous"])


def _solve(batches):
    """The weights that solve the normal equations with a small ridge, from the sums of all tasks, which are added up one after the other."""
    total = None
    for batch in batches:
        for sums in batch.column(0):
            own = np.frombuffer(sums.as_buffer())
            total = own.copy() if total is None else np.add(total, own, out=total)
    if total is not None:
        half = np.triu_indices(WIDTH + 1)
        left = np.zeros((WIDTH + 1, WIDTH + 1))
        left[half] = total[: len(half[0])]
        left = np.triu(left) + np.triu(left, 1).T
        left[np.diag_indices(WIDTH)] += 1e-3
        weights = np.linalg.solve(left, total[len(half[0]) :].reshape(WIDTH + 1, -1))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Codes:
    """A model of the language labels, fitted on at most fit_rows documents of each language that are not held out.

    Up to EXHAUSTIVE languages have all possible bits, more have random codes whose length grows with the logarithm of their number. The normal equations are summed up by each of
    FIT_TASKS tasks, then added up and solved by one, so that the driver gets the weights alone and no matrix of features by features.
    """
    spark = docs.sparkSession
    rows = cut(learning_rows(docs, docs.select("doc_id", F.col("lang").alias("y")), fit_rows).select("doc_id", "y", "text").coalesce(FIT_TASKS).sortWithinPartitions("doc_id"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    codes = Codes(languages)
    if len(languages) < 2:
        return codes
    equations = partial(_equations, share={y: 1 / n for y, n in counts.items()}, languages=languages, code=codes.code)
    # at most FIT_TASKS sums of fixed size; cut, so that they are made by FIT_TASKS tasks and not by the one that adds them up
    [solved] = cut(rows.mapInArrow(equations, "sums binary")).coalesce(1).mapInArrow(_solve, "weights binary").collect()
    codes = Codes(languages, np.frombuffer(solved["weights"]).reshape(WIDTH + 1, -1))
    model = spark.sparkContext.broadcast(codes)
    right = sum(np.frombuffer(r["right"]).reshape(codes.code.shape) for r in rows.mapInArrow(partial(_right, model=model), "right binary").toLocalIterator())
    return codes.trusted(right / np.array([[counts[y]] for y in languages]))


def identify(docs: DataFrame, codes: Codes, text: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "_") -> DataFrame:
    """keep columns and, after prefix, lang (a learned language, or `und` if the text is null or has no letter), score (0 to 1), ambiguous.

    Every whole text is read; language labels, source and id are no inputs. `und` has score 0 and is ambiguous; with nothing
    learned all rows are `und`. Texts of any length are read whole. Repeated rows each give their row; an empty table gives none; columns not in keep may have any names.
    """
    made = {f"{prefix}{m}": m for m in ("lang", "score", "ambiguous")}
    carried = Carried(docs, keep, text, made)
    model = docs.sparkSession.sparkContext.broadcast(codes)
    return carried.restore(carried.run(partial(_predict, text=carried.text, codes=model), "lang string, score double, ambiguous boolean"), made)


def with_fold(found: DataFrame) -> DataFrame:
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_ambiguous").alias("ambiguous"))
