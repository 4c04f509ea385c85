"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown level by level on binned statistics and kept as flat arrays, one row per tree, so that all trees of a
slice of documents are walked with a few numpy gathers per level.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numeric import byte_table, text_slices, word_hashes, words
from .sampling import held_out, learning_rows
from .shared import Carried, kept_arrays

#: Labelled documents of each class that a model is fitted on at most.
FIT_ROWS = 10_000
TREES, DEPTH, BINS, RATE, SHRINK = 80, 4, 64, 0.15, 1.0

STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "bracket", "stop_mark", "exclaim", "non_ascii",
    "newline", "distinct_words", "top_word", "adjacent_repeat", "distinct_lines", "line_length", "short_words", "long_words", "ends_in_mark", "distinct_pairs",
)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars.encode())] = 1
    return out


CLASSES = np.stack([_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789"), _table("|#$%&*@^~+=_`<>\\/"), _table("()[]{}"), _table(".,;:?"), _table("!"), np.repeat([0.0, 1.0], 128), _table("\n")])


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int):
    """Of each row: the number of distinct hashes, and how often the most frequent occurs."""
    if not len(rows):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, r[first], np.diff(np.append(first, len(r))))
    return np.bincount(r[first], minlength=n).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per text; all are 0 for an empty one."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)
    low, starts, ends, rows = words(data, offsets, byte_table("space"))
    hashes = word_hashes(low, starts, ends)
    count = np.bincount(rows, minlength=n).astype(float)
    many = np.maximum(count, 1)
    length = (ends - starts).astype(float)
    by_word = lambda v: np.bincount(rows, weights=v, minlength=n) / many
    distinct, top = _distinct(rows, hashes, n)
    same_row = rows[1:] == rows[:-1] if len(rows) else np.zeros(0, bool)
    again = np.bincount(rows[1:][same_row & (hashes[1:] == hashes[:-1])], minlength=n) if len(rows) else np.zeros(n)
    pairs, _ = _distinct(rows[1:][same_row], (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])[same_row], n) if len(rows) else (np.zeros(n), 0)
    line = np.ones(256, bool)
    line[10] = False
    _, ls, le, lr = words(data, offsets, line)
    lines = np.bincount(lr, minlength=n).astype(float)
    fresh, _ = _distinct(lr, word_hashes(low, ls, le), n)
    kinds = [_per_row(c[data], offsets) / some for c in CLASSES]
    mark = (CLASSES[4] + CLASSES[5] + CLASSES[2])[data[ends - 1]] if len(ends) else np.zeros(0)
    columns = [np.log1p(size), np.log1p(count), by_word(length), *kinds, distinct / many, top / many, again / many, fresh / np.maximum(lines, 1), np.log1p(size / np.maximum(lines, 1)), by_word(length <= 3), by_word(length >= 12), by_word(mark), pairs / many]
    return np.stack(columns, axis=1)


class Forest:
    """Boosted trees for a 0/1 target in flat arrays: node i of a tree has the children 2i + 1 and 2i + 2.

    weight: how much each row counts (1 without it), in the base rate and in every sum of gradients.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None):
        n, width = x.shape if len(x) else (0, len(STATISTICS))
        nodes = (1 << DEPTH) - 1
        self.feature = np.zeros((TREES, nodes), np.int32)
        self.threshold = np.full((TREES, nodes), np.inf)
        self.leaf = np.zeros((TREES, nodes + 1))
        w = np.ones(n) if weight is None else weight
        rate = ((w * y).sum() + 0.5) / (w.sum() + 1.0)
        self.base = float(np.log(rate / (1 - rate)))
        if n == 0 or y.min() == y.max():
            return
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        flat = binned + np.arange(width) * BINS
        margin = np.full(n, self.base)
        for t in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = w * (p - y), w * p * (1 - p)
            at = np.zeros(n, np.int64)
            for level in range(DEPTH):
                first, width_now = (1 << level) - 1, 1 << level
                key = ((at - first)[:, None] * (width * BINS) + flat).ravel()
                shape = (width_now, width, BINS)
                gs = np.bincount(key, np.repeat(g, width), width_now * width * BINS).reshape(shape)
                hs = np.bincount(key, np.repeat(h, width), width_now * width * BINS).reshape(shape)
                gl, hl = gs.cumsum(2), hs.cumsum(2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + SHRINK) + (gt - gl) ** 2 / (ht - hl + SHRINK) - gt**2 / (ht + SHRINK)
                gain[(hl < 1) | (ht - hl < 1)] = 0
                best = gain.reshape(width_now, -1).argmax(1)
                for k in range(width_now):
                    f, b = divmod(int(best[k]), BINS)
                    if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                        self.feature[t, first + k], self.threshold[t, first + k] = f, edges[f][b]
                at = self._down(x, t, at)
            leaf = at - nodes
            total_g, total_h = np.bincount(leaf, g, nodes + 1), np.bincount(leaf, h, nodes + 1)
            self.leaf[t] = -RATE * total_g / (total_h + SHRINK)
            margin += self.leaf[t][leaf]

    def _down(self, x, t, at):
        return 2 * at + 1 + (x[np.arange(len(x)), self.feature[t, at]] > self.threshold[t, at])

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1: all trees are walked at once."""
        at = np.zeros((len(x), TREES), np.int64)
        tree, row = np.arange(TREES)[None, :], np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        margin = self.base + self.leaf[tree, at - ((1 << DEPTH) - 1)].sum(1)
        return 1 / (1 + np.exp(-margin))


def _measure(batches):
    for part, data, offsets in text_slices(batches, "text"):
        x = statistics(data, offsets)
        values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
        kept = ["doc_id", "y", "total"]
        yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), values], [*kept, "x"])


def _score(batches, text: str, forest):
    model = forest.value
    for part, data, offsets in text_slices(batches, text):
        names, arrays = kept_arrays(part)
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(model.score(statistics(data, offsets)))], [*names, "score"])


def class_weights(y: np.ndarray, total: np.ndarray) -> np.ndarray:
    """A weight for each sampled row, 1 on average, so that each class has the share of its total; 1 for all rows if every row was taken."""
    w = total / np.bincount(y, minlength=2)[y]
    return w * (len(w) / w.sum()) if len(w) else w


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Forest:
    """A model of labels.quality (1 or more: good), fitted on at most fit_rows documents of each class that are not held out.

    Sampled rows are weighted by the share of their class in all learnable labels, so that a score means the same at every size of the input.
    Statistics are computed where the texts are; the driver gets len(STATISTICS) numbers for each document of the sample. Without
    labels every score is 0.5; with one class alone scores are near that class.
    """
    wanted = labels.select("doc_id", (F.col("quality") >= 1).cast("int").alias("y"))
    rows = learning_rows(docs, wanted, fit_rows)
    kind = next(f.dataType.simpleString() for f in rows.schema.fields if f.name == "doc_id")
    got = rows.mapInArrow(_measure, f"doc_id {kind}, y int, total long, x array<double>").orderBy("doc_id").toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS)) if got.num_rows else np.zeros((0, len(STATISTICS)))
    y = got.column("y").to_numpy().astype(np.int64)
    return Forest(x, y.astype(float), class_weights(y, got.column("total").to_numpy().astype(float)))


def score_quality(docs: DataFrame, forest: Forest, text: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "_") -> DataFrame:
    """keep columns and, after prefix, score (0 to 1; higher: better) of every whole text.

    A null or empty text is scored by the statistics of an empty text. Labels, language, source and id are no inputs of the score. Repeated
    rows each give their row; an empty table gives none; columns not in keep may have any names.
    """
    carried = Carried(docs, keep, text, (f"{prefix}score",))
    model = docs.sparkSession.sparkContext.broadcast(forest)
    return carried.restore(carried.run(partial(_score, text=carried.text, forest=model), "score double"), {f"{prefix}score": "score"})


def with_fold(scored: DataFrame, cutoff: float = 0.7) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= cutoff).cast("int").alias("predicted"))
