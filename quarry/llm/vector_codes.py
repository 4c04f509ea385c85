"""Vector code compression: codebooks of vector parts by rounds of assignment and integer means, summed by a reduction tree."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, cut, sized_join

#: Vectors of one block.
BLOCK_ROWS = 4096


def whole_parts(vectors: pa.Array, scale: int):
    """(kept, sizes, values, starts) of lists: which take part, their lengths, all components as floor(scale * x), and where each list begins.

    A list takes part if it is there and all its components are finite numbers.
    """
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = vectors.flatten()
    there = flat.is_valid().to_numpy(zero_copy_only=False)
    x = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    fine = there & np.isfinite(x)
    bad = np.concatenate([[0], np.cumsum(~fine)])
    kept = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[starts[1:]] == bad[starts[:-1]])
    with np.errstate(over="ignore"):
        x = np.floor(np.where(fine, x, 0.0) * float(scale))
    return kept, sizes, x, starts[:-1]


def _columns(batch, name: str, scale: int, width: int, limit: float):
    """(rows, block) for blocks of a batch: the row numbers of vectors of width components, and those components, one row for each dimension."""
    kept, sizes, x, starts = whole_parts(batch.column(batch.schema.get_field_index(name)), scale)
    rows = np.flatnonzero(kept & (sizes == width))
    for at in range(0, len(rows), BLOCK_ROWS):
        own = rows[at : at + BLOCK_ROWS]
        block = x[starts[own][None, :] + np.arange(width)[:, None]]
        if np.abs(block).max(initial=0) >= limit:
            raise OverflowError(f"a component is beyond {limit:.0f} after scaling, so that distances could leave 64 bits")
        yield own, block.astype(np.int64)


def nearest(block: np.ndarray, books: np.ndarray):
    """(codes, distances) by part for a block (dimension, vector) and books (part, entry, position): the nearest entry, ties to the lower, distances being summed dimension by dimension."""
    parts, entries, inside = books.shape
    codes, least = np.empty((parts, block.shape[1]), np.int64), np.empty((parts, block.shape[1]), np.int64)
    for p in range(parts):
        far = np.zeros((entries, block.shape[1]), np.int64)
        for d in range(inside):
            off = block[p * inside + d][None, :] - books[p, :, d][:, None]
            off *= off
            far += off
        codes[p] = far.argmin(axis=0)
        least[p] = np.take_along_axis(far, codes[p][None, :], axis=0)[0]
    return codes, least


def _part_blocks(batches, name: str, scale: int, width: int, limit: float):
    for batch in batches:
        for _, block in _columns(batch, name, scale, width, limit):
            yield pa.RecordBatch.from_arrays([pa.array([block.tobytes()], pa.binary())], ["block"])


def _add(total, row, books):
    """Sums and counts of the parts by their nearest entries, added to a total."""
    parts, entries, inside = books.value.shape
    block = np.frombuffer(row[0], np.int64).reshape(parts * inside, -1)
    sums, counts = total if total is not None else (np.zeros((parts, entries, inside), np.int64), np.zeros((parts, entries), np.int64))
    codes, _ = nearest(block, books.value)
    for p in range(parts):
        np.add.at(counts[p], codes[p], 1)
        for d in range(inside):
            np.add.at(sums[p, :, d], codes[p], block[p * inside + d])
    return sums, counts


def _merge(a, b):
    if a is None or b is None:
        return b if a is None else a
    return a[0] + b[0], a[1] + b[1]


def _smallest(batches, name: str, vec_id: str, scale: int, entries: int):
    """The entries smallest ids of a task with the least vector of each."""
    held: dict[int, list[float]] = {}
    for batch in batches:
        kept, sizes, x, starts = whole_parts(batch.column(batch.schema.get_field_index(name)), scale)
        ids = batch.column(batch.schema.get_field_index(vec_id))
        kept &= ids.is_valid().to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(kept)
        own = ids.fill_null(0).to_numpy(zero_copy_only=False)[rows]
        if len(own) == 0:
            continue
        distinct = np.unique(own)
        last = distinct[min(entries, len(distinct)) - 1]
        for r, i in zip(rows[own <= last], own[own <= last], strict=True):
            v = x[starts[r] : starts[r] + sizes[r]].tolist()
            held[int(i)] = min(held.get(int(i), v), v)
        held = dict(sorted(held.items())[:entries])
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["id", "v"])


def _assign(batches, name: str, scale: int, books, limit: float):
    """Codes and errors of all vectors that take part; null ones for those of another length."""
    parts, entries, inside = books.value.shape
    for batch in batches:
        kept = whole_parts(batch.column(batch.schema.get_field_index(name)), scale)[0]
        codes, errors = np.empty(batch.num_rows, object), np.zeros(batch.num_rows, np.int64)
        for rows, block in _columns(batch, name, scale, parts * inside, limit):
            found, least = nearest(block, books.value)
            text = found.astype(np.uint8).T.copy().tobytes().hex()
            for k, r in enumerate(rows):
                codes[r] = text[2 * parts * k : 2 * parts * (k + 1)]
            errors[rows] = least.sum(axis=0)
        code = pa.array(codes.tolist(), pa.string())
        error = pa.array(errors, pa.int64(), mask=~code.is_valid().to_numpy(zero_copy_only=False))
        ids = [batch.column(batch.schema.get_field_index(n)) for n in ("id", "label")]
        yield pa.RecordBatch.from_arrays([*ids, code, error], ["id", "label", "code", "error"]).filter(pa.array(kept))


def _digest(books: np.ndarray) -> str:
    import hashlib

    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", depth: int = 2) -> np.ndarray:
    """Codebooks (part, entry, position) of whole numbers: they start as the parts of the vectors of the least ids; each round gives every part to its nearest entry and
    makes each entry the floor of its parts' mean; an entry without parts stays.

    Blocks of vectors stand by dimension; sums and counts are added by treeAggregate. The books are parts * entries * positions numbers, whatever the size of the table.
    With fewer vectors than entries there are as many entries; without any, none.
    """
    spark = vectors.sparkSession
    bounded(spark)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    small = rows.mapInArrow(partial(_smallest, name="v", vec_id="id", scale=scale, entries=entries), "id long, v array<double>")
    first = small.groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    width = len(first[0].v)
    if width == 0 or width % parts:
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    start = np.array([r.v for r in first if len(r.v) == width])
    limit = _limit(width)
    if np.abs(start).max() >= limit:
        raise OverflowError(f"a component is beyond {limit:.0f} after scaling, so that distances could leave 64 bits")
    books = start.astype(np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    blocks = rows.select("v").mapInArrow(partial(_part_blocks, name="v", scale=scale, width=width, limit=limit), "block binary").rdd
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        sums, counts = blocks.treeAggregate(None, partial(_add, books=sent), _merge, depth)
        sent.unpersist()
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    return books


def _limit(width: int) -> float:
    """Components below this have squared distances whose sum stays below 2^62."""
    return float(2**30 / np.sqrt(width))


def encode(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of vectors compressed to the numbers of their parts' nearest codebook entries.

    Components count as floor(scale * x). Rows whose vector is null or holds null or non-finite components go; the codebooks are those of fit(). code: two hex digits for each part; error: the squared
    distances summed over the parts; label_error: the errors summed over the rows of the same label, nulls together; codebooks_sha256: all entries' components by part, entry and position.
    Of rows that repeat an id the least vector may start an entry; every row has a code. Rows without an id have a code and start no entry. A vector of another
    length than that of the least id has a null code and error. No more than 256 entries fit two digits. Components that could take distances beyond 64 bits are an error. An empty table gives no rows; other columns may have any names.
    """
    if entries > 256:
        raise ValueError("two hex digits name 256 entries at most")
    spark = vectors.sparkSession
    books = fit(vectors, parts, entries, rounds, scale, vec_id, vector)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    kind = rows.schema["label"].dataType.simpleString()
    if books.shape[1] == 0:
        # there may still be vectors, without ids
        coded = rows.filter(F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    else:
        sent = spark.sparkContext.broadcast(books)
        coded = cut(rows.mapInArrow(partial(_assign, name="v", scale=scale, books=sent, limit=_limit(parts * books.shape[2])), f"id long, label {kind}, code string, error long"))
    total = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same"))
    out = sized_join(coded, total, coded["label"].eqNullSafe(total["same"]), "left", 48)
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(_digest(books)).alias("codebooks_sha256"))
