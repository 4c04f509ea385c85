"""Exact n-gram Jaccard join in the metric space of shingle sets, for connected groups of near-duplicates.

The Jaccard distance is a metric, so pivots and the triangle inequality bound what can be near what. Documents taken from the whole corpus as pivots do not
tell it apart, as nearly all distances are close to 1; so the space is first cut into regions that no link leaves:

1. Sets within the radius differ in at most D shingles. Shingles are hashed into D + 1 + e parts; two linked sets agree in e + 1 parts at least. A part's
   name is a hash of the shingles that fall into it; sets with a part of the same name share a region. Of a set with E <= e empty parts, e + 1 - E parts that are
   not empty agree with those of any set linked to it, so the first D + 1 parts that are not empty hold one of them and are all that is named. Sizes are
   binned, with D for the sets of a bin and all larger ones that can link to them; a set is replicated to the lower bins where it can
   have links. Shingles of more than one document in HEAVY are left out of the parts, which keeps the bound.
2. A region too large for one task is cut again by the shingles that are rarest in it: with all shingles in one order, the first size - needed + 1 ones of two linked sets
   have one in common. Shingles are ordered by the sets of the region that hold them, so that shared lines and passages come last, and only sets that
   share one of their rarest shingles stay in a region.
3. Inside a region documents become pivots until each document is within the radius of one (its Voronoi cell); documents between one and two radii from a pivot
   are replicated to its cell's boundary and compared, unless they are connected already: by the triangle inequality no other document can link into it.
4. A region that is still too large does the same over the cluster, several pivots at a time: documents within the radius of pivots are connected to them and form the cell of
   the nearest; those within two radii are replicated to the cell's boundary and joined with it, in blocks; all that are in no cell go on as a region of their own, with more pivots.

Links are verified by integer arithmetic on whole sets.
"""

from __future__ import annotations

import bisect
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .numeric import U64, byte_table, long_lists, mix, text_slices, word_hashes, words
from .shared import cut, partitions, sized_join

#: A shingle in more than one of so many documents tells no sets apart; so the list of such shingles has at most that number times the mean set size entries.
HEAVY = 512
#: Documents that local counts of frequent shingles are made of.
BLOCK_ROWS = 4096
#: Documents and shingles of a region that one task joins at most; pivots of a larger region, and times more of them at each level.
REGION_ROWS, REGION_SHINGLES, PIVOTS, MORE_PIVOTS = 8000, 6_000_000, 16, 4
#: Sets with one rare shingle that a task chains at most, and tasks that chain those with one frequent shingle.
CHAIN_ROWS, REST_PARTS = 1 << 16, 64
#: Documents and shingles of a large region that are measured against pivots at once.
SHARE_ROWS, SHARE_SHINGLES = 1000, 1_000_000
RATIO = 1.4
#: Share of a set that should be left without frequent shingles for its parts to be filled.
SHARE = 0.9
#: Part names and documents that a Python worker compares before any are shuffled.
BLOCK_NAMES = 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int):
    """(hashes, row of each, set sizes): the distinct n-word shingles of each row, by row and hash."""
    rows_n = len(offsets) - 1
    low, starts, ends, rows = words(data, offsets, byte_table("space"))
    h = word_hashes(low, starts, ends)
    count = np.bincount(rows, minlength=rows_n)
    first = np.cumsum(count) - count
    m = max(len(h) - n + 1, 0)
    code = np.zeros(m, U64)
    for j in range(n):
        code = mix(code * U64(0x9E3779B97F4A7C15) + h[j : j + m])
    whole = rows[:m] == rows[n - 1 : n - 1 + m]
    row, code = rows[:m][whole], code[whole]
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        short = np.zeros(len(few), U64)
        for j in range(n - 1):
            has = count[few] > j
            short[has] = mix(short[has] * U64(0x9E3779B97F4A7C15) + h[first[few][has] + j])
        short = mix(short + count[few].astype(U64))
        row, code = np.concatenate([row, few]), np.concatenate([code, short])
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    row, code = row[new], code[new]
    return code, row, np.bincount(row, minlength=rows_n)


def _sums(values: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 of values by key, exact in two halves of 32 bits."""
    lo = np.bincount(key, (values & U64(0xFFFFFFFF)).astype(float), n).astype(U64)
    hi = np.bincount(key, (values >> U64(32)).astype(float), n).astype(U64)
    return lo + (hi << U64(32))


def set_names(code: np.ndarray, row: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return mix(_sums(mix(code), row, len(sizes)) + sizes.astype(U64) * U64(0xD6E8FEB86659FD93))


def bins(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(largest size, most differing shingles D, spare parts e) of each bin of set sizes."""
    tops, differ, spare, top, below = [], [], [], 1, 0
    while below < 1 << 31:
        d = top * (100 - percent) // percent

        def filled(e, d=d, least=SHARE * (below + 1)):
            empty = (d + 1 + e) * math.exp(-least / (d + 1 + e))
            return empty + 2 * math.sqrt(empty) <= e

        tops.append(top)
        differ.append(d)
        spare.append(2 + bisect.bisect_left(range(2, d + 4), True, key=filled))
        top, below = max(top + 1, int(top * RATIO)), top
    return np.array(tops), np.array(differ), np.array(spare)


def _parts(code: np.ndarray, row: np.ndarray, here: np.ndarray, k: np.ndarray, table, tag: int):
    """(names, row of each, rows with more than e empty parts) of the parts of rows `here` in bin k of each."""
    _, differ, spare = table
    m = np.where(here, differ[k] + 1 + spare[k], 0)
    base = np.cumsum(m) - m
    mine = here[row]
    r, c = row[mine], code[mine]
    salted = mix(c + (2 * k[r] + tag).astype(U64) * U64(0xA0761D6478BD642F))
    part = ((salted >> U64(32)) * m[r].astype(U64)) >> U64(32)
    key = base[r] + part.astype(np.int64)
    total = int(m.sum())
    sums, filled = _sums(c, key, total), np.bincount(key, minlength=total) > 0
    who = np.repeat(np.arange(len(m)), m)
    over = here & (np.bincount(who[~filled], minlength=len(m)) > spare[k])
    order = np.cumsum(filled)
    order -= np.append(0, order)[base][who]
    keep = filled & ((order <= differ[k][who] + 1) | over[who])
    if tag:
        keep |= over[who]
    number = np.arange(total) - base[who]
    name = mix(mix(sums + U64(1)) + mix(((2 * k[who] + tag) * (1 << 40) + number).astype(U64)))
    return name[keep], who[keep], over


def part_names(code: np.ndarray, row: np.ndarray, sizes: np.ndarray, light: np.ndarray, percent: int, table):
    """(names, row of each): of the parts of each set in its own bin, and in the lower bins whose sets can be linked to it.

    Parts are of the light shingles. A set that has too many empty ones names all others, and its parts of all shingles too: of two linked sets, either
    one has few empty parts, and they share one of its named parts, or both name parts of all shingles.
    """
    tops = table[0]
    names, owners = [], []
    code = mix(code)
    own = np.searchsorted(tops, sizes)
    least = np.searchsorted(tops, -(-sizes * percent // 100))
    for step in range(int((own - least).max(initial=0)) + 1):
        k = np.maximum(own - step, 0)
        here = (own - step >= least) & (sizes > 0)
        name, who, over = _parts(code[light], row[light], here, k, table, 0)
        names.append(name)
        owners.append(who)
        if over.any():
            name, who, _ = _parts(code, row, over, k, table, 1)
            names.append(name)
            owners.append(who)
    return np.concatenate(names), np.concatenate(owners)


def _frequent(batches, n: int, heavy: int):
    """(code, n): shingles in at least one in heavy / 2 of the distinct sets of a block of documents."""
    held, docs, seen = [], 0, np.zeros(0, U64)

    def block():
        sets = np.concatenate(held)
        value, count = np.unique(sets, return_counts=True)
        often = count >= max(8, 2 * docs // heavy)
        return pa.RecordBatch.from_arrays([pa.array(value[often].view(np.int64)), pa.array(count[often])], ["code", "n"])

    for _, data, offsets in text_slices(batches, "text"):
        code, row, sizes = shingle_sets(data, offsets, n)
        names = set_names(code, row, sizes)
        fresh = np.zeros(len(sizes), bool)
        fresh[np.unique(names, return_index=True)[1]] = True
        fresh &= ~np.isin(names, seen)
        if fresh.any():
            seen = np.concatenate([seen, names[fresh]])
            held.append(code[fresh[row]])
            docs += int(fresh.sum())
        if docs >= BLOCK_ROWS or sum(map(len, held)) > 1 << 21:
            yield block()
            held, docs, seen = [], 0, np.zeros(0, U64)
    if held:
        yield block()


def _combined(held):
    """One record batch of held (doc_id, sizes, fp, names, rows of names): of sets with a part of the same name the first one keeps it and the
    others keep a link to the set before them, so that a name leaves the block once; of copies the first one with an id has all."""
    ids = pa.concat_arrays([h[0] for h in held])
    sizes, fp, names = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
    starts = np.cumsum([0, *(len(h[1]) for h in held)])
    who = np.concatenate([h[4] + a for h, a in zip(held, starts, strict=False)])
    fresh = np.zeros(len(fp), bool)
    # rows without an id have no names, so that they come last
    first = np.argsort(~ids.is_valid().to_numpy(zero_copy_only=False), kind="stable")
    fresh[first[np.unique(fp[first], return_index=True)[1]]] = True
    names, who = names[fresh[who]], who[fresh[who]]
    order = np.lexsort((who, names))
    names, who = names[order], who[order]
    again = np.zeros(len(names), bool)
    again[1:] = names[1:] == names[:-1]
    near = np.unique(np.stack([who[again], who[np.flatnonzero(again) - 1]], axis=1), axis=0).reshape(-1, 2)
    back = np.argsort(who[~again], kind="stable")
    parts = long_lists(names[~again][back].view(np.int64), np.bincount(who[~again], minlength=len(fp)))
    links = long_lists(fp[near[:, 1]].view(np.int64), np.bincount(near[:, 0], minlength=len(fp)))
    return pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(fp.view(np.int64)), parts, links], ["doc_id", "n_shingles", "fp", "parts", "near"])


def _describe(batches, n: int, percent: int, heavy, table):
    """(doc_id, n_shingles, fp, parts, near) of each document, a block of documents at a time."""
    common, held, count = heavy.value, [], 0
    for part, data, offsets in text_slices(batches, "text"):
        code, row, sizes = shingle_sets(data, offsets, n)
        light = np.ones(len(code), bool)
        if len(common):
            light = common[np.minimum(np.searchsorted(common, code), len(common) - 1)] != code
        ids = part.column(part.schema.get_field_index("doc_id"))
        names, who = part_names(code, row, np.where(ids.is_valid().to_numpy(zero_copy_only=False), sizes, 0), light, percent, table)
        held.append((ids, sizes, set_names(code, row, sizes), names, who))
        count += len(names)
        if count >= BLOCK_NAMES or sum(len(h[1]) for h in held) >= BLOCK_ROWS:
            yield _combined(held)
            held, count = [], 0
    if held:
        yield _combined(held)


def _sets(batches, n: int):
    """(gid, fp, codes) of each document whose set has the name that is asked for."""
    for part, data, offsets in text_slices(batches, "text"):
        code, row, sizes = shingle_sets(data, offsets, n)
        lists = long_lists(code.view(np.int64), sizes)
        asked = part.column(part.schema.get_field_index("fp")).to_numpy()
        right = pa.array(set_names(code, row, sizes).view(np.int64) == asked)
        out = pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("gid")), pa.array(asked), lists], ["gid", "fp", "codes"])
        yield out.filter(right)


def _tokens(batches, n: int, percent: int, heavy):
    """(gid, fp, slack, codes, rest) of each asked set: the length of its prefix less the number of its light shingles, these, and those frequent ones that its prefix has in any case."""
    common = heavy.value
    for part, data, offsets in text_slices(batches, "text"):
        code, row, sizes = shingle_sets(data, offsets, n)
        asked = part.column(part.schema.get_field_index("fp")).to_numpy()
        right = set_names(code, row, sizes).view(np.int64) == asked
        light = np.ones(len(code), bool)
        if len(common):
            light = common[np.minimum(np.searchsorted(common, code), len(common) - 1)] != code
        many = np.bincount(row[light], minlength=len(sizes))
        first = sizes - -(-sizes * percent // 100) + 1
        # codes ascend within a row
        behind = row[~light]
        order = np.arange(len(behind)) - np.searchsorted(behind, behind)
        rest = order < (first - many)[behind]
        lists = [long_lists(code[light].view(np.int64), many), long_lists(code[~light][rest].view(np.int64), np.bincount(behind[rest], minlength=len(sizes)))]
        out = [part.column(part.schema.get_field_index("gid")), pa.array(asked), pa.array((first - many).astype(np.int32)), *lists]
        yield pa.RecordBatch.from_arrays(out, ["gid", "fp", "slack", "codes", "rest"]).filter(pa.array(right))


class Region:
    """The sets of a region with an index from shingles to sets; each shingle that but one set has is left out."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.sizes, n = sizes, len(sizes)
        ordered = np.sort(flat)
        again = np.zeros(len(ordered), bool)
        again[1:] = ordered[1:] == ordered[:-1]
        # the second of each run of equal shingles
        shared = ordered[again & ~np.append(False, again[:-1])] if len(ordered) else ordered
        del ordered, again
        ids, owner, ends = [], [], np.cumsum(sizes)
        for at in range(0, len(flat) if len(shared) else 0, SHARE_SHINGLES):
            part = flat[at : at + SHARE_SHINGLES]
            spot = np.minimum(np.searchsorted(shared, part), len(shared) - 1)
            fit = np.flatnonzero(shared[spot] == part)
            ids.append(spot[fit])
            owner.append(np.searchsorted(ends, fit + at, "right"))
        ids, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, owner))
        self.ids, self.at = ids, np.searchsorted(owner, np.arange(n + 1))
        order = np.argsort(ids, kind="stable")
        self.owners, self.first = owner[order], np.searchsorted(ids[order], np.arange(len(shared) + 1))

    def overlaps(self, ids: np.ndarray) -> np.ndarray:
        """Shingles that each set of the region shares with the given ones."""
        lo, hi = self.first[ids], self.first[ids + 1]
        n = hi - lo
        spot = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.owners[spot], minlength=len(self.sizes))

    def of(self, i: int) -> np.ndarray:
        return self.overlaps(self.ids[self.at[i] : self.at[i + 1]])


def region_links(flat: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """The root of each set: sets have the same root if links of the region connect them."""
    n = len(sizes)
    region, parent = Region(flat, sizes), np.arange(n)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def connect(i, common):
        union = sizes[i] + sizes - common
        for j in np.flatnonzero(100 * common >= percent * union):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)

    placed, done, boundary = np.zeros(n, bool), np.zeros(n, bool), []
    window = 1 - 2 * (100 - percent) / 100 - 1e-9
    for i in range(n):
        if placed[i]:
            continue
        common = region.of(i)
        done[i] = True
        union = sizes[i] + sizes - common
        linked = 100 * common >= percent * union
        placed |= linked
        placed[i] = True
        connect(i, common)
        boundary.append((i, np.flatnonzero(~linked & (common >= window * union))))
    for pivot, near in boundary:
        for y in near:
            if not done[y] and root(y) != root(pivot):
                done[y] = True
                connect(y, region.of(y))
    return np.array([root(i) for i in range(n)], np.int64)


def _groups(batches, key: str):
    """Runs of rows of equal key in a sorted Arrow stream, as tables."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        breaks = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(breaks, breaks[1:]):
            if held and held[0][0] != keys[a]:
                yield pa.Table.from_batches([x for _, x in held])
                held = []
            held.append((keys[a], batch.slice(a, b - a)))
    if held:
        yield pa.Table.from_batches([x for _, x in held])


def _flat(table: pa.Table):
    codes = table.column("codes").combine_chunks()
    sizes = codes.value_lengths().to_numpy()
    return codes.flatten().to_numpy().view(U64), sizes


def _join(batches, percent: int):
    """(u, v): links that connect the sets of each group as all its links do."""
    for table in _groups(batches, "gid"):
        fp = table.column("fp").to_numpy()
        flat, sizes = _flat(table)
        roots = region_links(flat, sizes, percent)
        other = np.flatnonzero((roots != np.arange(len(fp))) & (fp != fp[roots]))
        if len(other):
            yield pa.RecordBatch.from_arrays([pa.array(fp[other]), pa.array(fp[roots[other]])], ["u", "v"])


def _measure(batches, percent: int):
    """(gid, fp, pivot, near, far) of the pivots of its group within one (near 1) or two (near 2) radii of each set, and their distance.

    Rows come by key, a share of a group, with copies of the group's pivots first.
    """
    window = 1 - 2 * (100 - percent) / 100 - 1e-9
    for table in _groups(batches, "key"):
        is_pivot = table.column("pivot").to_numpy()
        own, pivots = table.filter(pa.array(~is_pivot)), table.filter(pa.array(is_pivot))
        if not own.num_rows:
            continue
        flat, sizes = _flat(own)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        fps, gid = own.column("fp").to_numpy(), own.column("gid")[0].as_py()
        codes, ends = _flat(pivots)
        for name, code in zip(pivots.column("fp").to_numpy(), np.split(codes, np.cumsum(ends)[:-1]), strict=True):
            common = np.bincount(owner[code[np.minimum(np.searchsorted(code, flat), len(code) - 1)] == flat], minlength=len(sizes))
            union = sizes + len(code) - common
            near = np.where(100 * common >= percent * union, 1, np.where(common >= window * union, 2, 0))
            found = np.flatnonzero(near)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), gid)), pa.array(fps[found]), pa.array(np.full(len(found), name)), pa.array(near[found].astype(np.int32)), pa.array(1 - common[found] / union[found])], ["gid", "fp", "pivot", "near", "far"])


GROUPED = "gid long, fp long, codes array<long>"


def _large(rows: DataFrame) -> DataFrame:
    """(gid, size) of the groups that are too large for a task. rows: gid, and n, the size of each set."""
    sizes = rows.groupBy("gid").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    return cut(sizes.filter((F.col("size") > 1) & ((F.col("size") > REGION_ROWS) | (F.col("shingles") > REGION_SHINGLES))))


def _cells(rows: DataFrame, large: DataFrame, percent: int, level: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links of sets to pivots, groups of cells with their boundaries, groups of all in no cell)."""
    pivots = PIVOTS * MORE_PIVOTS**level
    order = Window.partitionBy("gid", "share").orderBy(F.xxhash64("fp", F.lit(level)), "fp")
    again = Window.partitionBy("gid").orderBy(F.xxhash64("fp", F.lit(level)), "fp")
    shares = large.select("gid", F.greatest(F.ceil(F.col("size") / SHARE_ROWS), F.ceil(F.col("shingles") / SHARE_SHINGLES)).alias("shares"))
    placed = sized_join(rows, shares, "gid", "inner", 24).withColumn("share", F.pmod(F.xxhash64("fp", F.lit(level)), F.col("shares")))
    # the first ones of each share, then of these: no task orders a whole region
    chosen = placed.select("gid", "fp", "share").distinct().withColumn("r", F.row_number().over(order)).filter(F.col("r") <= pivots)
    chosen = cut(chosen.withColumn("r", F.row_number().over(again)).filter(F.col("r") <= pivots).select("gid", "fp"))
    copies = sized_join(placed, chosen, ["gid", "fp"], "left_semi", 24).dropDuplicates(["gid", "fp"]).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    named = placed.withColumn("pivot", F.lit(False)).unionByName(copies.withColumn("pivot", F.lit(True)))
    named = named.select(F.xxhash64("gid", "share").alias("key"), "gid", "fp", "codes", "pivot").repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key")
    measured = cut(named.mapInArrow(partial(_measure, percent=percent), "gid long, fp long, pivot long, near int, far double"))
    edges = measured.filter("near = 1").select(F.col("fp").alias("u"), F.col("pivot").alias("v"))
    cell = cut(measured.filter("near = 1").groupBy("gid", "fp").agg(F.min(F.struct("far", "pivot")).alias("m")).select("gid", "fp", F.col("m.pivot").alias("pivot")))
    outside = rows.join(cell.select("gid", "fp"), ["gid", "fp"], "left_anti").select(F.xxhash64("gid", F.lit(level)).alias("gid"), "fp", "codes")
    member = cell.withColumn("near", F.lit(1)).unionByName(measured.filter("near = 2").select("gid", "fp", "pivot", "near"))
    near = rows.select("gid", "fp", F.size("codes").alias("n")).join(member, ["gid", "fp"])
    blocks = lambda which: F.greatest(F.ceil(F.count_if(F.col("near") == which) * 2 / REGION_ROWS), F.ceil(F.sum(F.when(F.col("near") == which, F.col("n"))) * 2 / REGION_SHINGLES))
    counts = cut(near.groupBy("gid", "pivot").agg(blocks(1).alias("n1"), blocks(2).alias("n2")).filter("n1 > 0 and n2 > 0"))
    mine, other = F.when(F.col("near") == 1, F.col("n1")).otherwise(F.col("n2")), F.when(F.col("near") == 1, F.col("n2")).otherwise(F.col("n1"))
    dealt = sized_join(member, counts, ["gid", "pivot"], "inner", 32).withColumn("i", F.pmod(F.xxhash64("fp"), mine)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), other - 1)))
    pair = F.when(F.col("near") == 1, F.struct("i", "j")).otherwise(F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    dealt = dealt.select("gid", "fp", F.xxhash64("gid", F.lit(level), "pivot", pair).alias("group"))
    crossed = rows.join(dealt, ["gid", "fp"]).select(F.col("group").alias("gid"), "fp", "codes")
    return edges, crossed, outside


def links(rows: DataFrame, large_rows: DataFrame | None, large: DataFrame, percent: int) -> DataFrame:
    """(u, v) of links between the sets of each group (gid, fp, codes) that connect what all links of the group connect; large_rows: those of the groups in large, which are cut first."""
    ready, edges, level = [rows], [], 0
    while large_rows is not None:
        large_rows = cut(large_rows)
        near, crossed, outside = _cells(large_rows, large, percent, level)
        edges.append(near)
        ready.append(crossed)
        outside = cut(outside)
        large = _large(outside.select("gid", F.size("codes").alias("n")))
        ready.append(sized_join(outside, large.select("gid"), "gid", "left_anti", 16))
        large_rows = None if large.isEmpty() else sized_join(outside, large.select("gid"), "gid", "left_semi", 16)
        level += 1
    groups = ready[0]
    for more in ready[1:]:
        groups = groups.unionByName(more)
    out = groups.repartition(partitions(rows.sparkSession), "gid").sortWithinPartitions("gid").mapInArrow(partial(_join, percent=percent), "u long, v long")
    for more in edges:
        out = out.unionByName(more)
    return out


def _asked(first: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, fp, n, gid) of one document of each set of each region."""
    return cut(first.join(regions.withColumnRenamed("node", "fp"), "fp").select(F.col("rep").alias("doc_id"), "fp", "n", F.col("root").alias("gid")))


def _rarest(texts: DataFrame, n: int, percent: int, heavy) -> DataFrame:
    """(node, root) of the sets that share one of their rarest shingles with others of their group. texts: gid, fp, text."""
    sets = texts.mapInArrow(partial(_tokens, n=n, percent=percent, heavy=heavy), "gid long, fp long, slack int, codes array<long>, rest array<long>")
    both = F.concat(F.transform("codes", lambda c: F.struct(c.alias("code"), F.lit(False).alias("rest"))), F.transform("rest", lambda c: F.struct(c.alias("code"), F.lit(True).alias("rest"))))
    # rows are as narrow as can be: a set is in one group, so that its name stands for both, and so does a hash of group and shingle
    found = sets.select("gid", "fp", "slack", F.explode(both).alias("c"))
    part = F.when(F.col("c.rest"), F.pmod(F.xxhash64("fp"), F.lit(REST_PARTS)) + 1).otherwise(0)
    found = found.select(F.xxhash64("gid", "c.code", part).alias("key"), "fp", F.when(~F.col("c.rest"), F.col("slack")).alias("slack"), F.when(F.col("c.rest"), F.xxhash64("gid", "c.code")).alias("whole"))
    found = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1 or slack is null")
    # light shingles that are in one set alone come first and link nothing
    own = Window.partitionBy("fp")
    rank = F.row_number().over(own.orderBy(F.col("slack").isNull(), "n", "key")) - F.count("slack").over(own)
    found = found.withColumn("at", rank).filter("slack is null or at <= slack")
    parts = F.when(F.col("slack").isNull(), F.lit(REST_PARTS)).when(F.col("n") > CHAIN_ROWS, F.ceil(F.col("n") / CHAIN_ROWS)).otherwise(1)
    names = found.select("fp", F.coalesce("whole", "key").alias("code"), parts.alias("parts"))
    names = names.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
    # sets of one name are chained in parts, and the first sets of the parts then
    within = Window.partitionBy("code", "part").orderBy("fp")
    chained = cut(names.select("code", "parts", F.col("fp").alias("u"), F.lag("fp").over(within).alias("v")).filter("v is not null or parts > 1"))
    heads = chained.filter("v is null").select("u", F.lag("u").over(Window.partitionBy("code").orderBy("u")).alias("v"))
    return components(chained.select("u", "v").unionByName(heads).filter("v is not null"))


def _regions(rows: DataFrame, n: int, percent: int, often) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, fp) of every row, and (node, root) of the sets that share a part with others. often: the frequent shingles.

    Part names are shuffled once and kept nowhere: next to each other in order, sets of one name are chained; each document's own row goes along under a name of its own.
    """
    kind = next(f.dataType.simpleString() for f in rows.schema.fields if f.name == "doc_id")
    describe = partial(_describe, n=n, percent=percent, heavy=often, table=bins(percent))
    found = rows.mapInArrow(describe, f"doc_id {kind}, n_shingles long, fp long, parts array<long>, near array<long>")
    named = found.select("doc_id", "n_shingles", "fp", "near", F.posexplode(F.array_prepend("parts", F.xxhash64("fp", "doc_id"))).alias("pos", "name"))
    named = named.select("name", "fp", F.when(F.col("pos") == 0, F.struct("doc_id", "n_shingles", "near")).alias("doc"))
    chained = named.withColumn("v", F.lag("fp").over(Window.partitionBy("name").orderBy("fp")))
    kept = cut(chained.filter(F.col("doc").isNotNull() | (F.col("v") != F.col("fp"))).select("doc", F.col("fp").alias("u"), "v"))
    base = kept.filter("doc is not null").select("doc.doc_id", "doc.n_shingles", F.col("u").alias("fp"))
    near = kept.filter("doc is not null").select("u", F.explode("doc.near").alias("v"))
    return base, components(near.unionByName(kept.filter("doc is null").select("u", "v")))


def _often(rows: DataFrame, n: int):
    """The sorted shingles of more than one document in HEAVY, as a broadcast; their number is bounded (see HEAVY)."""
    total = rows.count()
    often = rows.select("text").mapInArrow(partial(_frequent, n=n, heavy=HEAVY), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") * HEAVY >= total)
    return rows.sparkSession.sparkContext.broadcast(np.sort(often.select("code").toArrow().column("code").to_numpy().view(U64)))


def _same_id(base: DataFrame) -> DataFrame:
    """(u, v): the sets of each id that has several, linked to the least of them."""
    sets = base.filter("doc_id is not null and n_shingles > 0")
    several = cut(sets.groupBy("doc_id").agg(F.min("fp").alias("v"), F.max("fp").alias("most")).filter("v < most").drop("most"))
    return sized_join(sets.select("doc_id", F.col("fp").alias("u")), several, "doc_id", "inner", 48).filter("u <> v").select("u", "v")


def _with_empty(out: DataFrame, base: DataFrame, named: DataFrame) -> DataFrame:
    """out with of_id: for a row without shingles the component of another row of its id that has some; else null."""
    empty = cut(base.filter("doc_id is not null and n_shingles = 0").select("doc_id").distinct())
    others = cut(sized_join(base.filter("n_shingles > 0"), empty, "doc_id", "left_semi", 32).select("doc_id", "fp").distinct())
    if others.isEmpty():
        return out.withColumn("of_id", F.lit(None).cast(base.schema["doc_id"].dataType))
    of_id = cut(others.join(named, "fp").groupBy("doc_id").agg(F.min("component").alias("of_id")))
    return sized_join(out, of_id, "doc_id", "left", 48)


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: the least doc_id of its component of links.

    Words are runs without ASCII white space, with A-Z in lower case; a set holds the distinct n-word shingles of the whole text, or all words as one shingle if
    they are fewer. Sets are linked if 100 * intersection >= percent * union. A null or empty text, or one without words, has size 0 and no
    links. A row without doc_id links nothing and has no component_id, rows that repeat an id count as one document that has several sets:
    these are in one component, and what links to any of them links to the document.
    An empty table gives no rows; other columns of docs may have any names.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    often = _often(rows, n)
    base, regions = _regions(rows, n, percent, often)
    first = cut(base.filter("doc_id is not null and n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")))
    asked = _asked(first, regions)
    texts = lambda some: sized_join(rows, some, "doc_id", "inner", 32).select("gid", "fp", "text")
    sets = lambda some: texts(some).mapInArrow(partial(_sets, n=n), GROUPED)
    large = _large(asked)
    large_sets = None
    if not large.isEmpty():
        again = cut(sized_join(asked, large.select("gid"), "gid", "left_semi", 16))
        finer = again.select("doc_id", "fp", "n").join(_rarest(texts(again), n, percent, often).withColumnRenamed("node", "fp"), "fp")
        asked = cut(sized_join(asked, large.select("gid"), "gid", "left_anti", 16).unionByName(finer.select("doc_id", "fp", "n", F.xxhash64("root").alias("gid"))))
        large = _large(asked)
        if not large.isEmpty():
            large_sets = sets(cut(sized_join(asked, large.select("gid"), "gid", "left_semi", 16)))
            asked = cut(sized_join(asked, large.select("gid"), "gid", "left_anti", 16))
    found = components(links(sets(asked), large_sets, large, percent).unionByName(_same_id(base)))
    rep = first.select("fp", "rep").join(found.withColumnRenamed("node", "fp"), "fp")
    least = rep.groupBy("root").agg(F.min("rep").alias("component"))
    linked = cut(rep.join(least, "root").select("fp", "component"))
    named = cut(sized_join(first.select("fp", "rep"), linked, "fp", "left", 16).select("fp", F.coalesce("component", "rep").alias("component")))
    out = _with_empty(sized_join(base, named, "fp", "left", 16), base, named)
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.coalesce("of_id", "doc_id")).when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
