"""Incremental ingestion, resumable evaluation, and a windowed monitor as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import code_hash
from ..operators.lineage import cut
from ..operators.skipsets import skip_known


def new_rows(incoming: DataFrame, known: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows whose key, of one column or several, is not known yet, one of each key; running it again on the same input gives none. A Bloom filter of the known keys spares new rows the comparison."""
    keys = [key] if isinstance(key, str) else key
    return skip_known(incoming, known, keys).dropDuplicates(keys)


#: Fixed name of Spark's state store that keeps its keys on disk instead of in memory.
DISK_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest_stream(spark: SparkSession, arriving: DataFrame, target: str, checkpoint: str, known: DataFrame | None = None, gate: Callable[[DataFrame], DataFrame] = lambda x: x, key: str = "content_hash") -> StreamingQuery:
    """Writes new, gated rows of a stream to a Parquet table, each content once over all batches and restarts.

    The keys that were seen are the state of a streaming deduplication, kept on executors' disks and versioned in the checkpoint folder by batch: a batch looks up its own keys only, so that its
    time does not grow with the target, which is never read. Keys of known (content_hash), which stand in other tables, are the state's first entries: they are a stream beside the
    arriving rows in the first batch, and that batch alone is compared with them. Batch n is the partition batch_id=n of the target, which a repetition after a
    failure overwrites, so that a crash between writing and committing leaves no row twice. Rows need a column code; null code has no key and is left out.
    """
    rows = gate(arriving).withColumn(key, code_hash(F.col("code"))).filter(F.col(key).isNotNull()).withColumn("_known", F.lit(False))
    if known is not None:
        seeds = _as_stream(spark, known.select(key).filter(F.col(key).isNotNull()).distinct(), f"{checkpoint}-known")
        rows = rows.unionByName(seeds.withColumn("_known", F.lit(True)), allowMissingColumns=True)

    def write(batch: DataFrame, number: int) -> None:
        new = batch.filter("not _known").drop("_known")
        if number == 0 and known is not None:
            new = new.join(known.select(key), key, "left_anti")
        new.withColumn("batch_id", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(target)

    before = spark.conf.get(_STATE, None)
    spark.conf.set(_STATE, DISK_STATE)
    try:
        return rows.dropDuplicates([key]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_STATE) if before is None else spark.conf.set(_STATE, before)


_STATE = "spark.sql.streaming.stateStore.providerClass"


def _as_stream(spark: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    """df as a stream of one batch; it is written once, so that a restarted query goes on with the same files."""
    if not _exists(spark, f"{folder}/_SUCCESS"):
        df.write.mode("overwrite").parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def stream_ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, gate: Callable[[DataFrame], DataFrame] = lambda x: x, known: DataFrame | None = None, files_per_batch: int | None = None) -> StreamingQuery:
    """ingest_stream() of the JSON files that arrive in a folder, files_per_batch of them at a time if it is given."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return ingest_stream(spark, reader.json(source), target, checkpoint, known, gate)


def read_ingested(spark: SparkSession, target: str, checkpoint: str) -> DataFrame:
    """Rows of the batches that the checkpoint has committed; those of a batch that was written and not committed will be written again and do not count."""
    done = spark.read.text(f"{checkpoint}/commits").select(F.regexp_extract(F.input_file_name(), "([0-9]+)$", 1).cast("int").alias("batch_id")).filter("batch_id is not null").distinct()
    return spark.read.parquet(target).join(F.broadcast(done), "batch_id", "left_semi")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def resume_plan(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_expected, n_done, action: a complete unit is skipped, a partial one is done again from scratch."""
    want = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_expected"))
    have = done.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_done"))
    n = F.coalesce("n_done", F.lit(0))
    action = F.when(n == F.col("n_expected"), "skip").when(n > 0, "redo").otherwise("run")
    return want.join(have, keys, "left").select(*keys, "n_expected", n.alias("n_done"), action.alias("action"))


def fill_missing(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """One record per sample: without a prediction, an empty one."""
    return samples.join(predictions, "sample_id", "left").withColumn("predicted", F.array_sort(F.coalesce("predicted", F.array().cast("array<string>"))))


class TimeLimit:
    """Ends a block with an error when it takes longer than some seconds; where a thread cannot be interrupted, or without a limit, it does nothing."""

    def __init__(self, seconds: float | None):
        self.seconds = seconds

    def __enter__(self):
        import signal
        import threading

        self.on = self.seconds is not None and threading.current_thread() is threading.main_thread()
        if self.on:
            self.before = signal.signal(signal.SIGALRM, self._stop)
            signal.setitimer(signal.ITIMER_REAL, self.seconds)
        return self

    def __exit__(self, *error):
        import signal

        if self.on:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, self.before)

    def _stop(self, *_):
        raise TimeoutError(f"no answer in {self.seconds} s")


def ask(detector: Callable, rows: list[tuple], seconds: float | None = None) -> tuple[dict, dict]:
    """(answers, errors) of a detector by sample id, whose call on all rows is one start of the tool. A call that fails, or takes longer than some seconds, is made again on each half of its
    rows, so that a row that breaks it loses its own answer alone."""
    try:
        with TimeLimit(seconds):
            return dict(detector(rows)), {}
    except Exception as e:
        if len(rows) == 1:
            return {}, {rows[0][0]: f"{type(e).__name__}: {e}"}
    middle = len(rows) // 2
    (a, x), (b, y) = ask(detector, rows[:middle], seconds), ask(detector, rows[middle:], seconds)
    return a | b, x | y


def evaluate(samples: DataFrame, detector: Callable, version: str, seconds: float | None = None) -> DataFrame:
    """Records of samples (variant, sample_id, ground_truth, code) under a detector: a function from a list of (id, code) to {id: set of classes}.

    A partition's batch is one call, which shares the start of a tool among its rows; a batch whose call fails or takes longer than `seconds` is halved until the rows that
    break it stand alone. A sample without an answer has an empty prediction, one that breaks the detector its error too.
    """

    def run(batches):
        import time

        import pandas as pd

        for pdf in batches:
            began = time.time()
            found, errors = ask(detector, list(zip(pdf["sample_id"], pdf["code"], strict=True)), seconds) if len(pdf) else ({}, {})
            each = int((time.time() - began) * 1000 // max(1, len(pdf)))
            yield pd.DataFrame({"variant": pdf["variant"], "sample_id": pdf["sample_id"], "ground_truth": pdf["ground_truth"], "predicted": [sorted(found.get(i, ())) for i in pdf["sample_id"]], "error": [errors.get(i) for i in pdf["sample_id"]], "latency_ms": each, "tool_version": version})

    kind = "variant string, sample_id string, ground_truth string, predicted array<string>, error string, latency_ms int, tool_version string"
    return samples.select("variant", "sample_id", "ground_truth", "code").mapInPandas(run, kind)


def resumable_evaluation(samples: DataFrame, detector: Callable, tool: str, version: str, path: str, seconds: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, plan): all records of a tool on samples (variant, sample_id, ground_truth, code), of which path keeps what earlier runs have done.

    A variant with as many records as samples is done and its detector is not called; one that has fewer or others is done again from scratch. Each tool and variant is a partition of
    path, replaced as a whole, so that a run that ends early leaves the variants before it whole. Every sample has one record in the end.
    """
    from ..sources.tables import PREDICTION, write_by_variant

    spark = samples.sparkSession
    read = lambda: spark.read.schema(PREDICTION).json(path).filter(F.col("tool") == tool) if _exists(spark, path) else spark.createDataFrame([], PREDICTION)
    plan = cut(resume_plan(samples, read(), ["variant"]))
    for variant in [r["variant"] for r in plan.filter("action <> 'skip'").select("variant").orderBy("variant").collect()]:
        asked = evaluate(samples.filter(F.col("variant") == variant), detector, version, seconds)
        records = asked.select(F.lit(tool).alias("tool"), "variant", "sample_id", "ground_truth", "predicted", F.col("error").alias("raw_output"), "latency_ms", "tool_version")
        write_by_variant(records, path)
    done = read().select("variant", "sample_id", "predicted")
    every = samples.select("variant", "sample_id", "ground_truth").join(done, ["variant", "sample_id"], "left")
    return every.withColumn("predicted", F.array_sort(F.coalesce("predicted", F.array().cast("array<string>")))), plan


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day", value: Column | None = None) -> DataFrame:
    """window_start, event_type, n, total of tumbling windows; on a stream, rows later than `late` are left out once their window is closed."""
    v = F.col("value") if value is None else value
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
