"""Removal of repeated strings of bytes, or of words, by distributed refinement of buckets of equal spans.

A position's bucket is the set of positions whose next q bytes are equal (q = length / 2); its identifier is a hash of those
bytes. To find every string of `length` bytes that starts at two places, buckets are refined from q bytes to `length` bytes: a longer bucket is named by the identifiers of the q-gram
buckets at the offsets that follow, 0, q, 2q and so on, and of its last q bytes; positions are grouped by these names, a bucket with one member is final and drops out, and the
others go to the next round. Identifiers at later offsets are looked up in the prefix sums of the text, where it is, and not kept in a table of all positions, which would be
shuffled in every round: at 16 bytes for each byte of text that is 26 times the input of the check tool, of which 4 times may lie on disk.

Round 0 names only one position of each string: the q-gram of least hash among those inside it (q = length / 2), so that equal
strings choose equal offsets. Around each such anchor, the starts of strings that hold it form a range. For a range of starts,
the bytes that all its strings share are its core and the bytes that they cover its cover. If the cover's bucket has another member, every
string of the range repeats; if the core's bucket has none, no string of it does; otherwise the range is cut into shorter ones (with one member of each repeated cover for comparison), for which
the next round asks the same, down to single strings. Only bucket names and positions are shuffled, never text, and
buckets are counted by partial aggregates, so a passage that a third of all documents hold costs no task more than others.
Beyond round 0 a bucket has two independent names of 64 bits each, so that strings of any corpus are told apart.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numeric import BASES, SLICE_BYTES, U64, byte_table, mix, prefix_sums, reduced, row_slices, run_hashes, span_hashes, text_slices, utf8, word_hashes, words
from .shared import Carried, cut, join_lists, kept_arrays, sized_join

#: Low bits of a selection key that hold the position; a segment is shorter than 2^22 bytes.
POSITION = U64((1 << 22) - 1)
#: Starts in one range of each round after the first.
ROUNDS = (25, 5, 1)
#: Bytes of text that results are built of at once.
OUTPUT_BYTES = 1 << 20

MADE = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
ITEMS = "g long, g2 long, f long, f2 long, fp long, c int, p int, a int, b int"
CORE, COVER = ["g", "g2"], ["f", "f2"]
#: What strings are made of: every byte, or words without ASCII white space.
UNITS = ("bytes", "words")


def _segments(offsets: np.ndarray, length: int, limit: int = SLICE_BYTES):
    """(row, from, to) in the slice: whole rows, or pieces of long rows that overlap by length - 1 bytes."""
    for row in range(len(offsets) - 1):
        a, b = int(offsets[row]), int(offsets[row + 1])
        if b - a <= limit + length:
            yield row, a, b
        else:
            for at in range(a, b - length + 1, limit):
                yield row, at, min(b, at + limit + length - 1)


def _elements(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a slice and where its rows begin, or the same of its words, each as a number."""
    if unit == "bytes":
        return data, offsets
    low, starts, ends, rows = words(data, offsets, byte_table("space"), lower=False)
    return reduced(word_hashes(low, starts, ends)), np.searchsorted(rows, np.arange(len(offsets)))


def _least(names: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least name in each run of width positions."""
    key = (names & ~POSITION) | np.arange(len(names), dtype=U64)
    have = 1
    while have < width:
        step = min(have, width - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    return (key & POSITION).astype(np.int64)


def _ranges(data: np.ndarray, offsets: np.ndarray, length: int):
    """Round 0 of a slice: (row, anchor, first start, last start, name of the anchor's q-gram), positions within rows.
    Every start of a string of length bytes is in one range."""
    q = length // 2
    found = []
    whole = max(np.diff(offsets), default=0) <= SLICE_BYTES + length
    pieces = [(0, len(data))] if whole else [(a, b) for _, a, b in _segments(offsets, length)]
    for lo, hi in pieces:
        if hi - lo < length:
            continue
        names = run_hashes(data[lo:hi], q)
        at = _least(names, length - q + 1)
        # a range ends where the anchor changes or a row begins, and with the last start in its row
        begins = offsets[(offsets > lo) & (offsets < lo + len(at))] - lo
        first = np.union1d(np.append(begins, 0), np.flatnonzero(at[1:] != at[:-1]) + 1)
        rows = np.searchsorted(offsets, first + lo, "right") - 1
        last = np.minimum(np.append(first[1:], len(at)) - 1, offsets[rows + 1] - lo - length)
        fits = first <= last
        first, last, rows = first[fits], last[fits], rows[fits]
        base = lo - offsets[rows]
        found.append((rows, at[first] + base, first + base, last + base, names[at[first]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, U64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _first(batches, length: int, unit: str):
    """(g, o): the bucket of each anchor and a name of its place."""
    for part, data, offsets in text_slices(batches, "text"):
        rows, p, _, _, g = _ranges(*_elements(data, offsets, unit), length)
        fp = part.column(part.schema.get_field_index("fp")).to_numpy().view(U64)[rows]
        place = mix(fp ^ mix(p.astype(U64)))
        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(place.view(np.int64))], ["g", "o"])


def _cells(rows, p, a, b, width: int, length: int):
    """Ranges cut where start - anchor passes a multiple of width: (row, p, a, b, core from, core to)."""
    shift = length - length // 2
    first, last = (a - p + shift) // width, (b - p + shift) // width
    n = last - first + 1
    which = np.repeat(np.arange(len(p)), n)
    index = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    rows, p, a, b = rows[which], p[which], a[which], b[which]
    c0 = index * width - shift
    c1 = np.minimum(c0 + width - 1, 0)
    return rows, p, np.maximum(a, p + c0), np.minimum(b, p + c1), p + c1, p + c0 + length


def _bucket(sums: np.ndarray, start: np.ndarray, end: np.ndarray, q: int, base: int) -> np.ndarray:
    """Names of the buckets of spans of at least q units: of a q-gram its identifier; of a longer span the identifiers of the q-gram buckets at its offsets 0, q, 2q ... and of its last q units, in order, and its length."""
    size = end - start
    name = span_hashes(sums, start, start + q, base)
    longer = np.flatnonzero(size > q)
    name[longer] = mix(name[longer] + mix(size[longer].astype(U64)))
    for k in range(1, -(-int(size.max(initial=0)) // q)):
        has = np.flatnonzero(k * q < size)
        at = np.minimum(start[has] + k * q, end[has] - q)
        name[has] = mix(name[has] ^ span_hashes(sums, at, at + q, base))
    return name


def _items(batches, length: int, unit: str, width: int | None):
    """Ranges with the bucket names of core (g, g2) and cover (f, f2): all of round 0, whose cores are the anchors' q-grams and have in g the name by which these were chosen, or those of each row's list `todo` cut to width."""
    for part, data, offsets in text_slices(batches, "text"):
        data, offsets = _elements(data, offsets, unit)
        if width is None:
            rows, p, a, b, chosen = _ranges(data, offsets, length)
            size = length - length // 2 + 1
        else:
            todo = part.column(part.schema.get_field_index("todo"))
            flat = todo.flatten()
            rows = np.repeat(np.arange(len(todo)), todo.value_lengths().to_numpy())
            p, a, b = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
            size = width
        rows, p, a, b, core, core_end = _cells(rows, p, a, b, size, length)
        start = offsets[rows]
        names = []
        for base in BASES:
            sums = prefix_sums(data, base)
            own = chosen if width is None and base == BASES[0] else _bucket(sums, start + core, start + core_end, length // 2, base)
            names.append((own, _bucket(sums, start + a, start + b + length, length // 2, base)))
        (g, f), (g2, f2) = names
        fp = part.column(part.schema.get_field_index("fp")).to_numpy()[rows]
        at = [pa.array(x.astype(np.int32)) for x in (core, p, a, b)]
        yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (g, g2, f, f2)), pa.array(fp), *at], [*CORE, *COVER, "fp", "c", "p", "a", "b"])


def _several(rows: DataFrame, names: list[str], place) -> DataFrame:
    """The buckets with two places at least, counted by partial aggregates."""
    two = rows.select(*names, place.alias("o")).groupBy(*names).agg(F.min("o").alias("lo"), F.max("o").alias("hi"))
    return cut(two.filter(F.col("lo") != F.col("hi")).select(*names, "lo"))


def _copies(texts: DataFrame, unit: str) -> DataFrame:
    """(fp, s, e): the whole of each text that several rows have."""
    several = cut(texts.groupBy("fp", F.octet_length("text").alias("size")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").groupBy("fp").agg(F.min("size").cast("int").alias("e")))
    if unit == "words":
        count = F.regexp_count("text", F.lit("[^ \\t\\n\\x0B\\f\\r]+"))
        several = sized_join(texts, several.select("fp"), "fp", "left_semi", 8).groupBy("fp").agg(F.min(count).cast("int").alias("e"))
    return several.select("fp", F.lit(0).alias("s"), "e")


def repeated_spans(texts: DataFrame, length: int = 400, unit: str = "bytes") -> DataFrame:
    """(fp, spans): merged spans of each text, in its bytes or words, that strings of length units cover which start at two places at least.

    texts: fp, text; fp is a 64-bit hash of the text, and rows of equal fp are copies. Texts without such strings have no row.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    long = texts.filter(F.octet_length("text") >= (length if unit == "bytes" else 2 * length - 1)).select("fp", "text")
    copies = _copies(long, unit).filter(F.col("e") >= length)
    covered = []
    shared = _several(long.mapInArrow(partial(_first, length=length, unit=unit), "g long, o long"), ["g"], F.col("o"))
    items = long.mapInArrow(partial(_items, length=length, unit=unit, width=None), ITEMS)
    live = cut(sized_join(items, shared.select("g"), "g", "left_semi", 8))
    for width in ROUNDS:
        place = F.xxhash64("fp", "a")
        known = cut(sized_join(live, _several(live, COVER, place), COVER, "left", 24))
        covered.append(known.filter("lo is not null").select("fp", F.col("a").alias("s"), (F.col("b") + length).alias("e")))
        # a repeated cover is settled; one member stays, as long as its core's bucket has ranges that are not
        unsettled = cut(known.filter("lo is null").select(*CORE).distinct())
        rest = sized_join(known.filter(F.col("lo").isNull() | (F.col("lo") == place)), unsettled, CORE, "left_semi", 16)
        todo = cut(rest.groupBy("fp").agg(F.collect_set(F.struct("p", "a", "b")).alias("todo")))
        items = cut(join_lists(long, todo, "fp", "inner").select("fp", "text", "todo").mapInArrow(partial(_items, length=length, unit=unit, width=width), ITEMS))
        live = sized_join(items, _several(items, CORE, F.xxhash64("fp", "c")).select(*CORE), CORE, "left_semi", 16)
    covered.append(live.select("fp", F.col("a").alias("s"), (F.col("b") + length).alias("e")))
    spans = covered[0]
    for more in covered[1:]:
        spans = spans.unionByName(more)
    # copies lose the whole text: each row of a large group of them would bring the same spans to one task
    spans = sized_join(spans, copies.select("fp"), "fp", "left_anti", 8).unionByName(copies)
    # spans that touch are merged as they pass in order, so that a text's list has its maximal runs alone
    order = Window.partitionBy("fp").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", (before.isNull() | (F.col("s") > before)).cast("long")).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("fp", "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).groupBy("fp").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[list[int]] = []
    for s, e in spans[np.argsort(spans[:, 0], kind="stable")].tolist():
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _word_spans(whole: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of bytes."""
    _, starts, ends, _ = words(np.frombuffer(whole, np.uint8), np.array([0, len(whole)]), byte_table("space"), lower=False)
    return [(int(starts[s]), int(ends[e - 1])) for s, e in spans]


def _remove(batches, text: str, unit: str, with_text: bool):
    for batch in batches:
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        for first, end in row_slices(offsets, OUTPUT_BYTES):
            yield _removed(batch.slice(first, end - first), text, unit, with_text)


def _removed(batch, text: str, unit: str, with_text: bool):
    names, arrays = kept_arrays(batch)
    values = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
    spans = batch.column(batch.schema.get_field_index("spans"))
    kept_texts, sizes, removed, runs, digests = [], [], [], [], []
    for value, own in zip(values, spans, strict=True):
        raw = value.as_py()
        whole = raw or b""
        got = own.as_py()
        gone = _merged(np.array([(x["s"], x["e"]) for x in got], np.int64).reshape(-1, 2)) if got else []
        if gone and unit == "words":
            gone = _word_spans(whole, gone)
        kept, at = [], 0
        for s, e in gone:
            kept.append(whole[at:s])
            at = e
        left = b"".join([*kept, whole[at:]]) if gone else whole
        sizes.append(len(whole))
        removed.append(len(whole) - len(left))
        runs.append(len(gone))
        digests.append(hashlib.sha256(left).hexdigest())
        if with_text:
            kept_texts.append(None if raw is None else left.decode("utf-8", "ignore") if gone else left.decode("utf-8"))
    more = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())]
    if with_text:
        more.append(pa.array(kept_texts, pa.string()))
    return pa.RecordBatch.from_arrays([*arrays, *more], [*names, *MADE, *(["kept"] * with_text)])


def remove_repeats(docs: DataFrame, length: int = 400, unit: str = "bytes", text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_text: bool = False, prefix: str = "_", passages: int = 0) -> DataFrame:
    """Every document without the bytes that repeated strings of length bytes, or words, cover.

    keep columns and, after prefix, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and with_text also kept: the
    kept bytes as text, without the rest of a character that a span's edge cuts. All occurrences are removed, the first too, and strings
    are judged on the input. Strings never span two documents. A null or empty text, and one shorter than length, loses nothing (null stays null);
    repeated rows are two places each, so that they lose all their bytes if they have length of them. Words are runs without ASCII white space, compared as they are
    written; a run of words is removed from its first byte to its last. With passages, n_passage_words counts the words of a text, whatever is removed, that strings of that many words cover which start twice. Texts of any length are searched whole, in overlapping segments. An empty table gives no rows; other columns of docs may have any names.
    """
    made = {f"{prefix}{m}": m for m in (*MADE, *(["kept"] * with_text))}
    carried = Carried(docs, keep, text, [*made, *([f"{prefix}n_passage_words"] * (passages > 0))])
    value = F.col(carried.text)
    rows = carried.rows.withColumn("fp", F.xxhash64(F.coalesce(value, F.lit("")), F.octet_length(value)))
    spans = cut(repeated_spans(rows.select("fp", value.alias("text")), length, unit))
    joined = join_lists(rows, spans, "fp", "left").withColumnRenamed("fp", "kfp")
    ddl = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    out = carried.run(partial(_remove, text=carried.text, unit=unit, with_text=with_text), ddl, joined)
    if passages:
        found = repeated_spans(rows.select("fp", value.alias("text")), passages, "words")
        counts = cut(found.select(F.col("fp").alias("kfp"), F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x.e - x.s).alias("n_passage_words")))
        out = sized_join(out, counts, "kfp", "left", 16)
        made[f"{prefix}n_passage_words"] = F.coalesce("n_passage_words", F.lit(0).cast("long"))
    return carried.restore(out, made)
