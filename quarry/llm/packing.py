"""Packing token sequences: first-fit decreasing with a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numeric import row_slices, text_slices, utf8
from .shared import Carried, kept_arrays, schema

#: Documents of one group, on average; a group is one unit of packing.
GROUP_DOCS = 1000
#: Sequences with at most this share of their length left open stay as they are.
OPEN_SHARE = 64
#: Bytes of text that are tokenised at once, a longer text alone, and bytes of their distinct chunks that are encoded at once.
TEXT_BYTES, CALL_BYTES = 8 << 20, 1 << 16

#: Fixed value: the pattern that splits text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose classes are the same in all versions of Unicode that the libraries follow.
_PLAIN = "[\t\n\r -~¡-ʯЀ-ҁҊ-ԓ]*"
#: A chunk after a cut: a blank and a character that is no white space by any definition; no token of the pattern goes over its start.
_CHUNK = " [!-~¡-ԯ]"


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a chunk of the pattern _CHUNK starts in the UTF-8 of the rows."""
    blank = data == 32
    blank[offsets[1:][np.diff(offsets) > 0] - 1] = False
    at = np.flatnonzero(blank)
    lead, after = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
    known = ((lead > 0x20) & (lead < 0x7F)) | ((lead > 0xC2) & (lead < 0xD4)) | ((lead == 0xC2) & (after > 0xA0)) | ((lead == 0xD4) & (after < 0xB0))
    return at[known]


class Encoder:
    """Ids of a byte-level vocabulary, as little-endian unsigned 32-bit numbers.

    Texts are cut before single blanks, where no token can go across, so that each distinct chunk (" word") of many texts is encoded once and its ids are
    put where it stands. Chunks are encoded many at a time, as one text, whose ids are cut by the bytes that each stands for: from the vocabulary's ranks,
    or, with characters outside a plain set or a very long run, by the tokenizer itself. Strings of special tokens are ordinary text.
    """

    def __init__(self, description: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(description)
        self.tokenizer.encode_special_tokens = True
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        # the printable stand-ins of bytes in the vocabulary's strings
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        ranks = {bytes(byte[c] for c in t): i for t, i in self.tokenizer.get_vocab(False).items() if t not in special}
        self.ranked = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(t) for t in ranks]

    def encode(self, text: str) -> np.ndarray:
        plain = len(text) < 100_000 and re.fullmatch(_PLAIN, text) is not None
        return np.array(self.ranked.encode_ordinary(text) if plain else self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, n): the ids of each chunk are n ones from start."""
        cut, plain = (pc.match_substring_regex(chunks, rf"\A{p}").to_numpy(zero_copy_only=False) for p in (_CHUNK, rf"{_PLAIN}\z"))
        ids, order, n = [], [], np.zeros(len(chunks), np.int64)
        for at in (np.flatnonzero(cut & plain), np.flatnonzero(cut & ~plain)):
            data, offsets = utf8(chunks.take(pa.array(at)))
            for a, b in row_slices(offsets, CALL_BYTES):
                ids.append(self.encode(data[offsets[a] : offsets[b]].tobytes().decode()))
                ends = np.searchsorted(np.cumsum(self.sizes[ids[-1]]), offsets[a + 1 : b + 1] - offsets[a]) + 1
                n[at[a:b]] = np.diff(ends, prepend=0)
                order.append(at[a:b])
        # how a text begins, up to its first cut
        for i in np.flatnonzero(~cut):
            ids.append(self.encode(chunks[i].as_py()))
            n[i] = len(ids[-1])
            order.append([i])
        start, order = np.zeros(len(chunks), np.int64), np.concatenate(order)
        start[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate(ids), start, n

    def many(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows, one row after the other, and where each row's end."""
        cuts, first = _cuts(data, offsets), offsets[:-1]
        rows = np.arange(len(first)) + np.searchsorted(cuts, first)
        bounds = np.full(len(first) + len(cuts) + 1, len(data), np.int32)
        bounds[rows] = first
        bounds[np.arange(len(cuts)) + np.searchsorted(first, cuts, "right")] = cuts
        chunks = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        ids, start, n = self.distinct(chunks.dictionary)
        which = chunks.indices.to_numpy()
        count = n[which]
        ends = np.cumsum(count)
        return ids[np.repeat(start[which] - ends + count, count) + np.arange(ends[-1])], ends[np.append(rows[1:], len(which)) - 1]

    def __call__(self, text: str) -> bytes:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.many(data, np.array([0, len(data)]))[0].tobytes()


def _tokenize(batches, description, end: int):
    """Adds ids (with the end id) and copy: 0, or another number for a further row with the same ids and id in this task."""
    from pyspark import TaskContext

    encoder, seen = Encoder(description.value), {}
    part = TaskContext.get().partitionId() << 32
    for rows, data, offsets in text_slices(batches, "t", TEXT_BYTES):
        names, arrays = kept_arrays(rows)
        ids, ends = encoder.many(data, offsets)
        ids = np.insert(ids, ends, end)
        places = 4 * np.append(0, ends + np.arange(1, len(ends) + 1)).astype(np.int32)
        keys, texts = (rows.column(rows.schema.get_field_index(k)) for k in "dt")
        copies = []
        for what in map(hash, zip(keys.to_pylist(), texts.to_pylist(), strict=True)):
            n = seen[what] = seen.get(what, -1) + 1
            copies.append(n and part + n)
        made = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(places), pa.py_buffer(ids)])
        yield pa.RecordBatch.from_arrays([*arrays, keys, made, pa.array(copies, pa.int64())], [*names, "d", "ids", "copy"])


class Bins:
    """Sequences of a capacity; a tournament tree over their open room finds the first that an item fits in."""

    def __init__(self, capacity: int, most: int):
        self.width = 1 << max(0, (most - 1).bit_length())
        #: room[1] is the largest room of all; the leaves are the sequences in order
        self.room = [capacity] * (2 * self.width)

    def put(self, size: int) -> int:
        """The first sequence with room for size, which it takes."""
        room, at = self.room, 1
        while at < self.width:
            at *= 2
            if room[at] < size:
                at += 1
        leaf = at
        room[at] -= size
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return leaf - self.width


def pack_lengths(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of pieces of documents in an order of their own.

    Whole multiples of the capacity are sequences of their own; what is left of each document is packed by first-fit decreasing. Sequences that
    stay open by more than capacity / OPEN_SHARE are then emptied, the emptiest first, into the room of the others, pieces being cut where the room ends.
    """
    pieces, tails, n = [], [], 0
    for d, size in enumerate(lengths):
        for start in range(0, size - capacity + 1, capacity):
            pieces.append((d, start, capacity, n, 0))
            n += 1
        if size % capacity:
            tails.append((size % capacity, d))
    tails.sort(key=lambda x: -x[0])
    bins, held = Bins(capacity, len(tails)), []
    for size, d in tails:
        at = bins.put(size)
        if at == len(held):
            held.append([])
        held[at].append((d, lengths[d] - size, size))
    _pour(held, capacity)
    for own in filter(None, held):
        offset = 0
        for d, start, size in own:
            pieces.append((d, start, size, n, offset))
            offset += size
        n += 1
    return pieces


def _pour(held: list[list[tuple[int, int, int]]], capacity: int) -> None:
    """Moves pieces out of the emptiest sequences into the room of the fullest open ones, until one open sequence is left."""
    room = [capacity - sum(p[2] for p in own) for own in held]
    open_ = sorted((b for b, r in enumerate(room) if r * OPEN_SHARE > capacity), key=lambda b: (room[b], b))
    lo, hi = 0, len(open_) - 1
    while lo < hi:
        to, source = open_[lo], open_[hi]
        if not held[source]:
            hi -= 1
        elif not room[to]:
            lo += 1
        else:
            d, start, size = held[source].pop()
            moved = min(size, room[to])
            held[to].append((d, start, moved))
            room[to] -= moved
            room[source] += moved
            if moved < size:
                held[source].append((d, start + moved, size - moved))


def _pack(table: pa.Table, capacity: int) -> pa.Table:
    """The pieces of one group; its documents stand in the order of their hashes."""
    table = table.sort_by([("h", "ascending"), ("copy", "ascending")])
    ids = table.column("ids").to_pylist()
    pieces = pack_lengths([len(x) // 4 for x in ids], capacity)
    doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
    group = table.column("g")[0].as_py() << 32
    cut = [ids[d][4 * s : 4 * (s + n)] for d, s, n, *_ in pieces]
    names = [n for n in table.schema.names if n.startswith("k")]
    sizes = np.array([len(x) // 4 for x in ids], np.int64)
    made = {"start": start, "length": length, "ids": pa.array(cut, pa.binary()), "doc_tokens": sizes[doc], "sequence_id": group + sequence, "offset": offset}
    kept = table.select(names).take(pa.array(doc))
    return pa.table([*kept.columns, *(pa.array(x) for x in made.values())], names=[*names, *made])


PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 0, seed: int = 1, doc_id: str = "doc_id", text: str = "text", keep=("doc_id",), group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces of documents in sequences of at most capacity tokens: the columns of keep, start, length, ids, doc_tokens, sequence_id, offset.

    A document is the ids of its text (null: none) by the vocabulary in the file tokenizer, then the id end; every id is in exactly one piece.
    ids has the piece's ids as little-endian unsigned 32-bit numbers (numpy.frombuffer(ids, "<u4")). start counts the document's ids before the
    piece, offset those before it in its sequence, without gaps from 0. Strings of special tokens count as ordinary text.
    Documents are dealt into groups of about group_docs by a seeded hash, and packed within each: documents longer than the capacity are cut at its multiples;
    the rests go by first-fit decreasing; at most one sequence of a group stays open by more than 1/64 of the capacity, as the emptiest are cut to fill the others.
    Shorter sequences are not cut to powers of two. Rows that repeat an id, null ids and equal rows are documents each, and equal rows of one task go to different groups.
    An empty table gives no rows; a kept column with the name of a made one is left out, others may have any names.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        description = spark.sparkContext.broadcast(f.read())
    carried = Carried(docs, keep, text, PIECES.replace(",", "").split()[::2])
    rows = docs.select(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(carried.names)), F.col(f"`{doc_id}`").cast("string").alias("d"), F.col(f"`{text}`").alias("t"))
    coded = carried.run(partial(_tokenize, description=description, end=end), "d string, ids binary, copy long", rows)
    groups = max(1, -(-docs.count() // group_docs))
    dealt = coded.withColumn("h", F.xxhash64(F.lit(seed), "d", "ids", "copy")).withColumn("g", F.pmod("h", F.lit(groups))).drop("d")
    kept = [f for f in coded.schema.fields if f.name.startswith("k")]
    packed = dealt.groupBy("g").applyInArrow(lambda group: _pack(group, capacity), T.StructType([*kept, *schema(PIECES).fields]))
    return carried.restore(packed, {f.name: f.name for f in schema(PIECES).fields})
