"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging of top lists."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, cut

#: Bytes of the query vectors of one block, which is all that is sent to the executors at once; more queries mean more blocks.
BLOCK_BYTES = 32 << 20
#: Queries and candidate vectors of one tile.
TILE_QUERIES, TILE_ROWS = 2048, 2048
#: Top lists that one step of the merging tree brings together.
FAN_IN = 64

LISTS = "query_id long, vec_id long, score long, part int"


#: Components are whole numbers below this, which a double holds exactly.
LARGEST = 2**53


def whole_vectors(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(id, v): rows that take part, each component as floor(scale * x). Rows without an id, and null
    vectors or those with null or non-finite components, take no part; an empty vector has score 0.
    A finite component beyond LARGEST after scaling is an error."""
    x = F.col(f"`{vector}`").cast("array<double>")
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    whole = lambda c: F.when(F.abs(c * float(scale)) < float(LARGEST), F.floor(c * float(scale)).cast("long")).otherwise(F.raise_error(F.lit("a component is beyond 2^53")).cast("long"))
    return df.filter(F.col(f"`{vec_id}`").isNotNull() & fine).select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.transform(x, whole).alias("v"))


def _products(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Exact integer products: by floating-point units where no sum can leave 2^53, by 64-bit ones below 2^63, else without a bound; a score beyond 64 bits is an error."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(tile).max(initial=0)) * queries.shape[1]
    if most < 2**53:
        return (queries.astype(np.float64) @ tile.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return queries @ tile.T
    whole = queries.astype(object) @ tile.T.astype(object)
    if whole.size and not (-(2**63) < whole.min() and whole.max() < 2**63):
        raise OverflowError("an inner product is beyond 64 bits")
    return whole.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int):
    """Of each row the k columns of highest score, ties to the smaller id; ids ascend."""
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
        rows, cols = np.nonzero(scores >= least[:, None])
    else:
        rows, cols = np.indices(scores.shape).reshape(2, -1)
    values = scores[rows, cols]
    order = np.lexsort((ids[cols], -values, rows))
    rows, cols, values = rows[order], cols[order], values[order]
    first = np.searchsorted(rows, rows, "left")
    top = np.arange(len(rows)) - first < k
    return rows[top], ids[cols[top]], values[top]


def _merged(held, found, k: int):
    """The k best of two top lists (rows, ids, scores)."""
    if held is None:
        return found
    rows, got, values = (np.concatenate(x) for x in zip(held, found, strict=True))
    order = np.lexsort((got, -values, rows))
    rows, got, values = rows[order], got[order], values[order]
    top = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
    return rows[top], got[top], values[top]


def _tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, tile: np.ndarray, k: int):
    """Top lists of a tile of queries among a tile of candidates, whose ids ascend."""
    scores = _products(queries, tile)
    least = np.iinfo(np.int64).min
    lo, hi = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    for r in np.flatnonzero(hi > lo):
        scores[r, lo[r] : hi[r]] = least
    rows, got, values = _best(scores, ids, k)
    fine = values > least
    return rows[fine], got[fine], values[fine]


def _search(batches, block, k: int):
    """Top lists of one partition: those of each pair of tiles are merged with those so far."""
    groups = block.value
    held = {}
    for batch in batches:
        for at in range(0, batch.num_rows, TILE_ROWS):
            part = batch.slice(at, TILE_ROWS)
            ids, lists = part.column(0).to_numpy(), part.column(1)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            for d in map(int, np.unique(sizes)):
                if d not in groups:
                    continue
                mine = np.flatnonzero(sizes == d)
                tile = lists.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), d)
                order = np.argsort(ids[mine], kind="stable")
                own, tile = ids[mine][order], tile[order]
                query_ids, queries = groups[d]
                for q in range(0, len(query_ids), TILE_QUERIES):
                    rows, got, values = _tile(query_ids[q : q + TILE_QUERIES], queries[q : q + TILE_QUERIES], own, tile, k)
                    held[d, q] = _merged(held.get((d, q)), (rows, got, values), k)
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for (d, q), (rows, got, values) in held.items():
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(groups[d][0][q + rows]), pa.array(got), pa.array(values), pa.array(np.full(len(rows), part, np.int32))], ["query_id", "vec_id", "score", "part"])


def _top(lists: DataFrame, k: int, *more: Column) -> DataFrame:
    by = Window.partitionBy("query_id", *more).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """The k candidates of highest integer inner product for each query: query_id, rank, vec_id, score.

    Components count as floor(scale * x), which must be below 2^53, and scores are exact; one beyond 64 bits is an error. A query's own id is not among its candidates; ties go to
    the smaller vec_id; with fewer than k candidates all are returned. Vectors that are null or hold null or non-finite
    components, and rows without an id, take no part; vectors of different lengths are not compared. Of rows that repeat
    a query's id one, with the smallest vector, is the query; rows that repeat a candidate are candidates each.
    Queries go to the executors in blocks of BLOCK_BYTES, whose top lists are written before the next block comes; within a task, tiles of queries meet tiles of candidates.
    An empty table gives no rows; other columns may have any names.
    """
    spark = candidates.sparkSession
    bounded(spark)
    shards = whole_vectors(candidates, vec_id, vector, scale)
    asked = whole_vectors(queries, vec_id, vector, scale).groupBy("id").agg(F.min("v").alias("v"))
    size = asked.agg(F.sum(8 * F.size("v") + 16)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    if blocks > 1:
        asked = cut(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))))
    tasks = shards.rdd.getNumPartitions()
    most = 4 * spark.sparkContext.defaultParallelism
    if tasks > most:
        # every task has a list for each query
        shards, tasks = shards.coalesce(most), most
    lists = None
    for b in range(blocks):
        got = (asked if blocks == 1 else asked.filter(F.col("block") == b)).select("id", "v").orderBy("id").toArrow()
        ids, sizes = got.column("id").to_numpy(), pc.list_value_length(got.column("v")).to_numpy()
        vectors = got.column("v").combine_chunks()
        groups = {}
        for d in np.unique(sizes):
            mine = np.flatnonzero(sizes == d)
            groups[int(d)] = ids[mine], vectors.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), int(d))
        found = _merge(shards.mapInArrow(partial(_search, block=spark.sparkContext.broadcast(groups), k=k), LISTS), max(1, tasks), k)
        found = found if blocks == 1 else cut(found)
        lists = found if lists is None else lists.unionByName(found)
    if lists is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return lists


def _merge(lists: DataFrame, tasks: int, k: int) -> DataFrame:
    """The top lists of all tasks as one list of each query, in a tree."""
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        lists = _top(lists.withColumn("part", (F.col("part") / FAN_IN).cast("int")), k, F.col("part")).drop("rank")
    return _top(lists, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
