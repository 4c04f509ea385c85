"""Reading tables, cutting lineage and schema helpers for the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of one Arrow batch between the JVM and a Python worker, where the session sets none.
BATCH_BYTES = "8m"
_BATCH, _CLEANUP = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded(spark: SparkSession) -> None:
    """Arrow batches of whole texts are held several times by each task, so that their bytes are bounded, not their rows alone."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read from there, so that no later job computes it again; its shuffle files, which nothing reads any more, go.

    The folder is the one that the cluster names in spark.checkpoint.dir; only where that is unset
    (a local session in tests) a temporary one is set.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    bounded(spark)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarry-checkpoint-"))
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        spark.conf.set(_CLEANUP, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of a join side that is broadcast at most; a larger side is shuffled.
BROADCAST_BYTES = 32 << 20


def sized_join(left: DataFrame, right: DataFrame, on, how: str, row_bytes: int) -> DataFrame:
    """left join right, right being broadcast only if it is counted to take BROADCAST_BYTES at most.

    right should be cheap to count (a result of cut()); row_bytes is what one of its rows takes.
    """
    if right.count() * row_bytes <= BROADCAST_BYTES:
        right = F.broadcast(right)
    return left.join(right, on, how)


def join_lists(left: DataFrame, lists: DataFrame, key: str, how: str) -> DataFrame:
    """left join lists (inner or left), lists having a wide row for each of some keys.

    The lists are shuffled; of left only the rows that have one, as far as the keys can be broadcast. lists should be a result of cut().
    """
    keys = lists.select(key)
    if lists.count() * 16 > BROADCAST_BYTES:
        return left.join(lists, key, how)
    found = left.join(F.broadcast(keys), key, "left_semi").join(lists, key)
    if how == "inner":
        return found
    return found.unionByName(left.join(F.broadcast(keys), key, "left_anti"), allowMissingColumns=True)


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def columns(df: DataFrame, first: str | None = None) -> list:
    """The columns of df, whatever their names, one of them first if it is named."""
    return [F.col(f"`{c}`") for c in sorted(df.columns, key=lambda c: c != first)]


def free_prefix(df: DataFrame) -> str:
    """Underscores that no column of df begins with."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


class Carried:
    """Columns that go with a text through a Python operator, under names of their own, so that no name of the input clashes.

    rows has k0, k1, ... for the columns in keep, and the text under the name `text`. A kept column with the name of a made one is left out.
    """

    def __init__(self, docs: DataFrame, keep, text: str, made):
        taken = {m.lower() for m in made}
        self.names = [k for k in keep if k.lower() not in taken]
        self.text = f"k{self.names.index(text)}" if text in self.names else "t"
        extra = [] if text in self.names else [F.col(f"`{text}`").alias("t")]
        self.rows = docs.select(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(self.names)), *extra)

    def run(self, function, ddl: str, rows: DataFrame | None = None) -> DataFrame:
        """function over the rows' Arrow batches; it drops t and other columns beside the kept ones and adds those of ddl."""
        out = schema(ddl)
        bounded(self.rows.sparkSession)
        rows = self.rows if rows is None else rows
        kept = [f for f in rows.schema.fields if f.name.startswith("k")]
        return rows.mapInArrow(function, T.StructType([*kept, *out.fields]))

    def restore(self, df: DataFrame, made: dict[str, object]) -> DataFrame:
        """The kept columns under their names, and made ones: name to column or name in df."""
        return df.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(self.names)), *((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in made.items()))


def kept_arrays(batch):
    """(names, arrays) of a batch's kept columns."""
    names = [n for n in batch.schema.names if n.startswith("k")]
    return names, [batch.column(batch.schema.get_field_index(n)) for n in names]
