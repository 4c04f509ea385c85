"""Caps, stratified splits and group splits without leakage."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from .hierarchy import inherited
from .lineage import cut

#: Bytes of a join side that is broadcast at most.
BROADCAST_BYTES = 32 << 20


def seeded(seed: int, key: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key), 256)


def seeded_rank(df: DataFrame, by: str, seed: int) -> DataFrame:
    """df with r, the rank (from 0) of each id in seeded order within its value of by, and n, the rows of that value.

    Ranks are counted per range of hashes first and within ranges then, so that a value that a third of all rows have is not ranked by one task.
    """
    rows = df.withColumn("_o", seeded(seed, F.col("id"))).withColumn("_k", F.struct(F.coalesce(by, F.lit("")).alias("v"), F.col(by).isNull().alias("z"), F.substring("_o", 1, 3).alias("b")))
    value = Window.partitionBy("_k.v", "_k.z")
    sizes = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_k", F.sum("_n").over(value).alias("n"), (F.sum("_n").over(value.orderBy("_k.b")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_k").orderBy("_o", "id")) - 1
    return rows.join(sizes, "_k").withColumn("r", F.col("_before") + rank).drop("_o", "_k", "_before")


def ordered_rank(df: DataFrame, by: str, order: str, ranges: int | None = None) -> DataFrame:
    """df with r, the rank (from 1) of each row within its value of by in the order of another column.

    Rows are dealt by sampled ranges of both columns, whatever their prefixes, and sorted there; a row's rank is its place in its task and what earlier tasks have of its value, so
    that no value is ranked by one task. The sorted rows are cut, as places must not change between the two readings.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(ranges, by, order).sortWithinPartitions(by, order)
    laid = cut(laid.withColumn("_i", F.monotonically_increasing_id())).withColumn("_p", F.shiftright("_i", 33))
    parts = laid.groupBy(by, "_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_p")) - F.col("_n")
    parts = cut(parts.select(F.col(by).alias("_by"), F.col("_p").alias("_q"), (before - F.col("_first") + 1).alias("_add")))
    if parts.count() * 64 <= BROADCAST_BYTES:
        parts = F.broadcast(parts)
    out = laid.join(parts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_p") == F.col("_q")))
    return out.select(*df.columns, (F.col("_i") + F.col("_add")).alias("r"))


def cap_per_group(df: DataFrame, keys: list[str], cap: int, order: list) -> DataFrame:
    """Rows with `kept`: the first cap of each group; rows whose last key is null are in no group."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    last = F.col(keys[-1])
    # rows in no group are kept as they are, and so are not ranked by one task
    return df.filter(last.isNotNull()).withColumn("kept", rank <= cap).unionByName(df.filter(last.isNull()).withColumn("kept", F.lit(True)))


def stratified_split(df: DataFrame, seed: int = 42, rare: int = 10) -> DataFrame:
    """id, cwe, split: 70 / 15 / 15 per class with one of each at least; a rare class gives one to test, one to val.

    Only ids and classes are shuffled.
    """
    rows = seeded_rank(df.select("id", "cwe"), "cwe", seed)
    val = F.greatest(F.bround(F.col("n") * 0.15), F.lit(1))
    train = F.greatest(F.bround(F.col("n") * 0.7), F.lit(1))
    train = F.least(train, F.col("n") - val - F.greatest(F.col("n") - train - val, F.lit(1)))
    common = F.when(F.col("r") < train, "train").when(F.col("r") < train + val, "val").otherwise("test")
    scarce = F.when((F.col("r") == 0) & (F.col("n") >= 3), "test").when((F.col("r") == 1) & (F.col("n") >= 2), "val").otherwise("train")
    return rows.select("id", "cwe", F.when(F.col("n") < rare, scarce).otherwise(common).alias("split"))


def simple_split(df: DataFrame, seed: int = 42) -> DataFrame:
    """id, cwe, split: 15 % val and test each, one at least; a class too small for that is all train."""
    rows = seeded_rank(df.select("id", "cwe"), "cwe", seed)
    part = F.greatest(F.bround(F.col("n") * 0.15), F.lit(1))
    train = F.col("n") - 2 * part
    return rows.select("id", "cwe", F.when((train < 1) | (F.col("r") < train), "train").when(F.col("r") < train + part, "val").otherwise("test").alias("split"))


def group_keys(df: DataFrame) -> DataFrame:
    """df with group_key: a hard negative has the key of its parent, whose own parent counts likewise, up any number of levels; else the repository, else the row's own id.

    A missing parent counts as none; hard negatives whose parents form a cycle have their own keys. Rows that do not say is_hard_negative are taken by their parent alone.
    """
    own = F.when(F.col("repo").isNotNull() & (F.col("repo") != ""), F.concat(F.lit("repo::"), "repo")).otherwise(F.concat(F.lit("solo::"), F.col("id")))
    hard = F.col("is_hard_negative") if "is_hard_negative" in df.columns else F.lit(True)
    rows = df.select("id", F.when(hard, F.col("parent_sample_id")).alias("parent"), own.alias("own"))
    keys = inherited(rows, "parent", "own", "group_key").select("id", "group_key")
    return df.join(keys, "id")


def dominant_label(df: DataFrame) -> DataFrame:
    """group_key, cwe, n: the most frequent class of each group, ties to the least name."""
    counts = df.groupBy("group_key", "cwe").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("group_key").orderBy(F.desc("n"), "cwe")
    return counts.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def split_targets(df: DataFrame) -> DataFrame:
    """cwe, n, train, val, test: rows that each split should have."""
    n = df.groupBy("cwe").agg(F.count(F.lit(1)).alias("n"))
    train, val = F.bround(F.col("n") * 0.7).cast("long"), F.bround(F.col("n") * 0.15).cast("long")
    return n.select("cwe", "n", train.alias("train"), val.alias("val"), (F.col("n") - train - val).alias("test"))


def _dealt(lacks: list[int], weight: int, m: int) -> list[int]:
    """How many of m equal groups each split gets, if each group in turn goes to the split that lacks most and then lacks weight less; ties go to the first."""
    above = lambda t: [max(0, (x - t) // weight + 1) for x in lacks]
    high, low = max(lacks) + 1, min(lacks) - weight * (m + 1)
    while high - low > 1:
        middle = (high + low) // 2
        if sum(above(middle)) >= m:
            low = middle
        else:
            high = middle
    # every lack above low is used up, and some of those that equal it
    out = above(low + 1)
    for s, n in enumerate(above(low)):
        out[s] += min(n - out[s], m - sum(out))
    return out


def _dealt_batches(batches, want: dict[str, dict[str, int]]):
    for batch in batches:
        counts = []
        for classes, less, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            got = _dealt([want[s][classes[0]] for s in K.SPLITS], -less[0], m)
            for s, n in zip(K.SPLITS, got, strict=True):
                for c, k in zip(classes, less, strict=True):
                    want[s][c] += k * n
            counts.append(got)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in counts], pa.int64()) for i in range(2))], ["kind", "train", "val"])


def greedy_group_split(df: DataFrame, seed: int = 42, fractions: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """id, cwe, group_key, split: whole groups go to the split that lacks most of the group's dominant class, large groups first.

    Groups with the same classes and counts are one kind, and kinds of one size come in order of their classes. A choice depends on all before it, but of a kind's groups only how many go to
    each split matters: one task streams the kinds (never groups or rows) and holds what splits lack; which groups these are is ranked in seeded order by ranges of hashes.
    """
    if abs(sum(fractions) - 1) > 1e-9:
        raise ValueError("fractions must sum up to 1")
    rows = df if "group_key" in df.columns else group_keys(df)
    counts = rows.groupBy("group_key", "cwe").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["cwe"]: r["n"] for r in counts.groupBy("cwe").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        raise ValueError("no samples")
    want = {s: {c: round(n * f) for c, n in totals.items()} for s, f in zip(K.SPLITS[:2], fractions, strict=False)}
    want["test"] = {c: n - want["train"][c] - want["val"][c] for c, n in totals.items()}
    # the most frequent class of a group, of least name, comes first
    parts = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "cwe"))).alias("parts")
    groups = counts.groupBy("group_key").agg(F.sum("n").alias("size"), parts).select(F.col("group_key").alias("id"), "size", F.col("parts.cwe").alias("classes"), F.col("parts.less").alias("less"))
    groups = groups.withColumn("kind", F.to_json(F.struct("classes", "less")))
    kinds = groups.groupBy("kind", "size", "classes", "less").agg(F.count(F.lit(1)).alias("m")).repartition(1).sortWithinPartitions(F.desc("size"), "classes", "less")
    dealt = kinds.select("kind", "classes", "less", "m").mapInArrow(partial(_dealt_batches, want=want), "kind string, train long, val long")
    ranked = seeded_rank(groups.select("id", "kind"), "kind", seed).join(dealt, "kind")
    chosen = ranked.select(F.col("id").alias("group_key"), F.when(F.col("r") < F.col("train"), "train").when(F.col("r") < F.col("train") + F.col("val"), "val").otherwise("test").alias("split"))
    return rows.join(chosen, "group_key").select("id", "cwe", "group_key", "split")


def cross_tab(df: DataFrame, key: str) -> DataFrame:
    """Counts of each key by split, zero where there are none."""
    return df.groupBy(key).pivot("split", K.SPLITS).agg(F.count(F.lit(1))).na.fill(0, K.SPLITS)


def leakage(df: DataFrame, key: str = "group_key") -> DataFrame:
    """(left, right, overlap): keys that two splits share."""
    has = df.groupBy(key).agg(F.collect_set("split").alias("s"))
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    sums = has.agg(*(F.count_if(F.array_contains("s", a) & F.array_contains("s", b)).alias(f"{a}_{b}") for a, b in pairs))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(a).alias("left_split"), F.lit(b).alias("right_split"), F.col(f"{a}_{b}").alias("overlap")) for a, b in pairs))).alias("x")).select("x.*")


def sample_per_class(df: DataFrame, k: int, keep_all: int = 30, seed: int = 1) -> DataFrame:
    """All rows of classes with at most keep_all rows, else k in seeded order."""
    chosen = seeded_rank(df.select("id", "cwe"), "cwe", seed).filter((F.col("n") <= keep_all) | (F.col("r") < k)).select("id")
    return df.join(chosen, "id", "left_semi")
