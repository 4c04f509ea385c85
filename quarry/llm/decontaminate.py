"""Benchmark decontamination by suffix arrays of the training text.

Each slice of documents gets a suffix array over its word sequence, as deep as a window is long. Every suffix of a test
item that begins a window is looked up in it by binary search, which gives all places where the window stands word for word; places that continue each other
make up the longest verbatim matches. Suffixes that no window can match, as they hold a word or a pair of words
that no test item has, are left out of the arrays.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numeric import byte_table, text_slices, utf8, word_hashes, words
from .shared import Carried, cut, kept_arrays

#: Bytes of benchmark text that are built into one block, on the driver, and blocks that one pass over the documents searches for; a larger benchmark takes more passes.
BLOCK_BYTES, BLOCKS = 1 << 20, 16
#: Words of an item that stay together; a longer one is searched for in parts.
PART_WORDS = 20_000

#: Pairs of a place in a slice and a place in an item that are held at once.
PAIRS = 1 << 19

FOUND = "n_words long, hit_spans array<struct<start:int,end:int>>, item_ids array<string>, matches array<struct<item_id:string,doc_word:int,item_word:int,n_words:int>>"


class Items:
    """A block of test items, as it is sent: their words as numbers, and the places where windows begin, by the first two words.

    A word takes 24 bytes at most, beside 8 for each distinct one. parts tells at which word of its item each text begins.
    """

    def __init__(self, ids: list[str | None], texts, size: int, parts=None):
        self.size, self.ids = size, ids
        self.parts = np.zeros(len(ids), np.int64) if parts is None else np.asarray(parts, np.int64)
        data, offsets = utf8(pa.array(texts, pa.string()))
        low, starts, ends, rows = words(data, offsets, byte_table("alnum"))
        self.vocabulary, number = np.unique(word_hashes(low, starts, ends), return_inverse=True)
        self.number, self.rows = (number + 1).astype(np.int32), rows.astype(np.int32)
        self.first = np.searchsorted(rows, np.arange(len(ids)))
        self.count = np.bincount(rows, minlength=len(ids))
        inner = np.arange(len(number)) - self.first[rows]
        begins = np.flatnonzero((inner + size <= self.count[rows]) | ((self.count[rows] < size) & (inner == 0)))
        self.least = int(self.count[rows[begins]].clip(max=size).min(initial=size))
        same = np.append(rows[1:] == rows[:-1], False)[: len(rows)]
        pair = self._first_two(np.arange(len(number)), same)
        self.pairs = np.unique(pair[same])
        order = begins[np.argsort(pair[begins], kind="stable")]
        self.begins, self.begin_pairs = order.astype(np.int32), pair[order]

    def _first_two(self, at: np.ndarray, same: np.ndarray) -> np.ndarray:
        number = self.number.astype(np.int64)
        after = np.append(number[1:], 0)[: len(number)]
        return number[at] << 32 | np.where(same[at], after[at], 0)

    def beginning(self, pairs: np.ndarray) -> np.ndarray:
        """Where windows begin whose first two words are among the distinct pairs, or whose only word begins one."""
        pairs = np.unique(np.concatenate([pairs, pairs >> 32 << 32]))
        lo, hi = np.searchsorted(self.begin_pairs, pairs, "left"), np.searchsorted(self.begin_pairs, pairs, "right")
        n = hi - lo
        spot = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.begins[spot]


class Windows:
    """Windows of a block of test items: all, or those that begin at given places."""

    def __init__(self, ids: list[str | None], texts, size: int):
        items = Items(ids, texts, size)
        self._take(items, items.begins)

    @classmethod
    def at(cls, items: Items, begins: np.ndarray) -> Windows:
        """The windows of items that begin at the given places."""
        self = cls.__new__(cls)
        self._take(items, begins)
        return self

    def _take(self, items: Items, begins: np.ndarray) -> None:
        self.size, self.ids = items.size, items.ids
        begins = np.sort(begins).astype(np.int64)
        row = items.rows[begins]
        length = np.minimum(items.count[row], items.size)
        keys = _keys(items.number, begins, length, items.size)
        self.keys, index, of = np.unique(keys, return_index=True, return_inverse=True)
        self.lengths = length[index]
        #: for each window, the items that have it and the word where it begins
        order = np.argsort(of, kind="stable")
        self.items, self.words, self.of = row[order].astype(np.int64), (begins - items.first[row] + items.parts[row])[order], of[order]


def _keys(number: np.ndarray, begins: np.ndarray, length: np.ndarray, size: int) -> np.ndarray:
    """The first words of each suffix (length of them, size at most) as a byte string that sorts as they do."""
    matrix = np.zeros((len(begins), size), ">u4")
    for j in range(size):
        has = np.flatnonzero(length > j)
        matrix[has, j] = number[begins[has] + j]
    return matrix.view(f"S{4 * size}").reshape(-1)


def _occurrences(number: np.ndarray, rows: np.ndarray, items: Items):
    """(windows, window, word position) of every occurrence in a slice, by binary search of test suffixes in its suffix array.

    Suffixes of items whose first two words begin no suffix of the slice are not looked up.
    """
    n = len(number)
    none = np.zeros(0, np.int64)
    if n == 0 or not len(items.begins):
        return None, none, none
    linked = np.zeros(n, bool)
    pair = number << 32
    if n > 1:
        near = np.flatnonzero((number[:-1] > 0) & (number[1:] > 0) & (rows[1:] == rows[:-1]))
        both = number[near] << 32 | number[near + 1]
        if len(items.pairs):
            spot = np.minimum(np.searchsorted(items.pairs, both), len(items.pairs) - 1)
            fine = items.pairs[spot] == both
            linked[near[fine]] = True
            pair[near[fine]] = both[fine]
    stops = np.flatnonzero(~linked)
    run = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n) + 1
    begins = np.flatnonzero((number > 0) & (run >= items.least))
    if not len(begins):
        return None, none, none
    w = Windows.at(items, items.beginning(np.unique(pair[begins])))
    if not len(w.keys):
        return None, none, none
    keys = _keys(number, begins, np.minimum(run[begins], w.size), w.size)
    array = np.argsort(keys, kind="stable")
    sorted_keys = keys[array]
    lo = np.searchsorted(sorted_keys, w.keys, "left")
    hi = np.searchsorted(sorted_keys, w.keys, "right")
    short = np.flatnonzero(w.lengths < w.size)
    if len(short):
        ends = w.keys[short].astype(f"S{4 * w.size}").view(">u4").reshape(len(short), w.size).copy()
        ends[np.arange(w.size)[None, :] >= w.lengths[short][:, None]] = 0xFFFFFFFF
        hi[short] = np.searchsorted(sorted_keys, ends.view(f"S{4 * w.size}").reshape(-1), "right")
    n_found = hi - lo
    window = np.repeat(np.arange(len(w.keys)), n_found)
    spot = np.repeat(lo, n_found) + np.arange(len(window)) - np.repeat(np.cumsum(n_found) - n_found, n_found)
    return w, window, begins[array[spot]]


def _runs(flags: np.ndarray, rows: np.ndarray):
    """(row, start, end) of the maximal runs of set flags inside rows."""
    at = np.flatnonzero(flags)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (rows[at[1:]] != rows[at[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return rows[at[first]], at[first], at[last] + 1


def _longest_of_one(item: int, entries: np.ndarray, places: list[np.ndarray], rows: np.ndarray, w: Windows):
    """(row, item, place, inner, words) of the longest match of one item in each row: one window of the item after the other, with the matches that end there."""
    before, length, last = np.zeros(0, np.int64), np.zeros(0, np.int64), -2
    best: dict[int, tuple] = {}
    for e in entries:
        inner = int(w.words[e])
        at = places[e]
        if inner != last + 1 or not len(before):
            run = np.ones(len(at), np.int64)
        else:
            spot = np.minimum(np.searchsorted(before, at - 1), len(before) - 1)
            run = np.where((before[spot] == at - 1) & (rows[at] == rows[before[spot]]), length[spot], 0) + 1
        begin = at - run + 1
        order = np.lexsort((begin, -run, rows[at]))
        first = order[np.unique(rows[at][order], return_index=True)[1]]
        for k in first:
            key = (-int(run[k]), int(begin[k]), -(inner - int(run[k]) + 1))
            row = int(rows[at[k]])
            if row not in best or key < best[row]:
                best[row] = key
        before, length, last = at, run, inner
    size = int(w.lengths[w.of[entries[0]]])
    found = np.array([(r, item, k[1], -k[2], size - 1 - k[0]) for r, k in sorted(best.items())], np.int64).reshape(-1, 5)
    return found.T


def _longest_matches(window: np.ndarray, at: np.ndarray, rows: np.ndarray, w: Windows):
    """(row, item, place, inner, words): the longest match of every item in every row, ties to the first place.

    Places of a window meet all items that have it, some items at a time, so that no more than PAIRS pairs are held.
    """
    order = np.lexsort((at, window))
    sorted_at = at[order]
    lo = np.searchsorted(window[order], np.arange(len(w.keys) + 1))
    often = np.diff(lo)[w.of]
    used = np.flatnonzero(often)
    per_item = np.bincount(w.items[used], often[used], len(w.ids)).astype(np.int64)
    total = np.cumsum(per_item)
    chunk = (total - 1) // PAIRS
    chunk[per_item > PAIRS] = -1
    found = []
    for c in np.unique(chunk[per_item > 0]):
        mine = used[chunk[w.items[used]] == c]
        if c < 0:
            for item in np.unique(w.items[mine]):
                entries = mine[w.items[mine] == item]
                entries = entries[np.argsort(w.words[entries], kind="stable")]
                found.append(_longest_of_one(int(item), entries, {e: sorted_at[lo[w.of[e]] : lo[w.of[e] + 1]] for e in entries}, rows, w))
            continue
        many = often[mine]
        which = np.repeat(np.arange(len(mine)), many)
        spot = np.repeat(lo[w.of[mine]], many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        place, item, inner = sorted_at[spot], w.items[mine][which], w.words[mine][which]
        # runs of pairs on one diagonal are one match
        row = rows[place]
        order = np.lexsort((place, place - inner, item, row))
        row, place, item, inner, length = row[order], place[order], item[order], inner[order], w.lengths[w.of[mine]][which][order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | ((place - inner)[1:] != (place - inner)[:-1]) | (place[1:] > place[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row)) - 1
        size = place[last] + length[last] - place[first]
        row, item, place, inner = row[first], item[first], place[first], inner[first]
        order = np.lexsort((-inner, place, -size, item, row))
        best = np.ones(len(order), bool)
        best[1:] = (row[order][1:] != row[order][:-1]) | (item[order][1:] != item[order][:-1])
        keep = order[best]
        found.append(np.stack([row[keep], item[keep], place[keep], inner[keep], size[keep]]))
    return np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)


def _search(batches, text: str, blocks, more: bool, keep_text: bool):
    """Adds what the windows of all blocks hit to each row; more: the rows come from an earlier pass and have its findings; keep_text: another pass follows."""
    table = byte_table("alnum")
    for part, data, offsets in text_slices(batches, text):
        n_rows = part.num_rows
        low, starts, ends, rows = words(data, offsets, table)
        hashes = word_hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        base = np.searchsorted(rows, np.arange(n_rows))
        old = [part.column(part.schema.get_field_index(k)).to_pylist() if more else [None] * n_rows for k in ("hit_spans", "item_ids", "matches")]
        spans: list[list] = [x or [] for x in old[0]]
        ids: list[set] = [set(x or ()) for x in old[1]]
        matches: list[list] = [x or [] for x in old[2]]
        change = np.zeros(len(starts) + 1, np.int64)
        for block in blocks:
            items = block.value
            if not len(items.vocabulary) or not len(starts):
                continue
            spot = np.minimum(np.searchsorted(items.vocabulary, hashes), len(items.vocabulary) - 1)
            w, window, at = _occurrences(np.where(items.vocabulary[spot] == hashes, spot + 1, 0), rows, items)
            if not len(at):
                continue
            np.add.at(change, at, 1)
            np.add.at(change, at + w.lengths[window], -1)
            for row, item, place, inner, size in zip(*_longest_matches(window, at, rows, w).tolist(), strict=True):
                name = w.ids[item]
                if name is not None:
                    ids[row].add(name)
                    matches[row].append({"item_id": name, "doc_word": place - int(base[row]), "item_word": inner, "n_words": size})
        for row, s, e in zip(*_runs(np.cumsum(change[:-1]) > 0, rows), strict=True):
            spans[row].append({"start": int(s - base[row]), "end": int(e - base[row])})
        names, arrays = kept_arrays(part)
        if text == "t" and keep_text:
            names, arrays = [*names, "t"], [*arrays, part.column(part.schema.get_field_index("t"))]
        kinds = [pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()), pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int32()), ("item_word", pa.int32()), ("n_words", pa.int32())]))]
        found = [pa.array(np.bincount(rows, minlength=n_rows)), *(pa.array(x, k) for x, k in zip((spans, [sorted(x) for x in ids], matches), kinds, strict=True))]
        yield pa.RecordBatch.from_arrays([*arrays, *found], [*names, "n_words", "hit_spans", "item_ids", "matches"])


def _parts(batches, size: int, most: int):
    """Items as texts of at most `most` words, which overlap by size - 1 words, with the word that each begins at."""
    table = byte_table("alnum")
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = text.encode()
            _, starts, ends, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), table) if len(raw) > most else (None, [0], [0], None)
            for at in range(0, max(1, len(starts) - size + 1), most - size + 1):
                whole = len(starts) <= most
                out[0].append(name)
                out[1].append(at)
                out[2].append(text if whole else raw[starts[at] : ends[min(at + most, len(ends)) - 1]].decode())
                if whole:
                    break
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["id", "at", "t"])


def _union_length(spans):
    """Words in the union of spans that may overlap."""
    step = lambda acc, s: F.struct((acc.n + F.greatest(s.end - F.greatest(s.start, acc.at), F.lit(0))).alias("n"), F.greatest(acc.at, s.end).alias("at"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc.n.cast("long"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", prefix: str = "_") -> DataFrame:
    """What each whole document shares with test items: keep columns and, after prefix, n_words, n_hit, item_ids, matches, hit_spans.

    Words are runs of ASCII letters and digits and of anything outside ASCII, with A-Z in lower case. A window is `size` consecutive words of an item, or
    all words of an item that has fewer but one; a document's word is hit if an occurrence of a window covers it.
    item_ids are the ids (as strings, sorted) of items with windows in the document; matches has the longest match of each (of an item of more than PART_WORDS words, of each
    of its parts, which overlap by size - 1 words). Null or empty
    texts have no words and no hits, nor do documents if the benchmark is empty. An item without an id hits words but
    is not listed; items that repeat an id count once. Texts and items of any length are searched whole; a window that many items and places share costs time, not memory.
    The benchmark is built into blocks of about BLOCK_BYTES of text on the driver, one after the other; a block takes 24 bytes a word, and BLOCKS of them go to the
    executors for one pass over the documents; a benchmark that takes several passes has their findings written in between. Other columns of docs may have any names; repeated rows each give their row, an empty table none.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("t")).filter(F.octet_length("t") > 0)
    items = items.mapInArrow(partial(_parts, size=size, most=max(PART_WORDS, 2 * size)), "id string, at long, t string")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    if blocks > 1:
        items = cut(items.withColumn("block", F.pmod(F.xxhash64("id", "at", "t"), F.lit(blocks))).repartitionByRange("block").sortWithinPartitions("block"))
    made = {f"{prefix}{m}": m for m in ("n_words", "n_hit", "item_ids", "matches", "hit_spans")}
    carried = Carried(docs, keep, text, made)
    rows = carried.rows
    for b in range(0, blocks, BLOCKS):
        sent = [_block(items if blocks == 1 else items.filter(F.col("block") == i), size) for i in range(b, min(blocks, b + BLOCKS))]
        last = b + BLOCKS >= blocks
        search = partial(_search, text=carried.text, blocks=sent, more=b > 0, keep_text=not last)
        rows = carried.run(search, FOUND if last or carried.text != "t" else "t string, " + FOUND, rows)
        rows = rows if last else cut(rows)
    return carried.restore(rows.withColumn("n_hit", _union_length(F.col("hit_spans"))), made)


def _block(items: DataFrame, size: int):
    """A block of items, sent to the executors."""
    got = items.select("id", "at", "t").orderBy("id", "at", "t").toArrow()
    return items.sparkSession.sparkContext.broadcast(Items(got.column("id").to_pylist(), got.column("t").to_pylist(), size, got.column("at").to_numpy()))
