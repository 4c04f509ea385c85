"""Bootstrap intervals in one pass, and areas under precision-recall curves without a global order in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics
from .lineage import cut

#: Bounds, in 2^32nds, below which a uniform number gives a Poisson weight of 0, 1, 2, ...
POISSON = [min(2**32, round(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)))) for k in range(13)]


def uniform(sample_id: Column, replicate: Column) -> Column:
    """A number below 2^32 of a sample in a replicate, from a hash of both: the same wherever and whenever it is asked for. A hash serves four replicates."""
    digits = F.md5(F.concat(sample_id, F.lit(":"), F.floor(replicate / 4).cast("string")))
    return F.conv(F.substring(digits, (replicate % 4) * 8 + 1, F.lit(8)), 16, 10).cast("long")


def poisson(u: Column) -> Column:
    """The Poisson(1) weight that a uniform number below 2^32 gives."""
    # the number is the one element of an array, so that it is computed once and compared often
    return F.transform(F.array(u), lambda v: sum(((v >= bound).cast("int") for bound in POISSON), F.lit(0)))[0]


def replicates(records: DataFrame, n: int, by: list[str] = metrics.BY) -> DataFrame:
    """by, replicate, ground_truth, predicted, weight: the weighted cells of n bootstrap replicates of records; 0 as replicate is the records themselves.

    Each record adds to all replicates as it is read, and tasks send one row for each cell and replicate.
    """
    numbered = records.select(*by, "sample_id", "ground_truth", "predicted", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("replicate"))
    drawn = numbered.withColumn("u", F.when(F.col("replicate") > 0, uniform(F.col("sample_id"), F.col("replicate") - 1)))
    weighted = drawn.withColumn("w", F.when(F.col("replicate") == 0, 1).otherwise(poisson(F.col("u")))).filter("w > 0")
    return weighted.groupBy(*by, "replicate", "ground_truth", "predicted").agg(F.sum("w").alias("weight"))


def bootstrap_intervals(records: DataFrame, n: int = 1000, level: float = 0.95, by: list[str] = metrics.BY) -> DataFrame:
    """by, metric, value, low, high of macro-F1, Matthews correlation and weighted kappa: percentiles (nearest rank) over n Poisson bootstrap replicates of the samples.

    A sample has the same weight for all tools and variants, so that their replicates are paired. Replicates in which a metric is not defined do not count.
    """
    cells = cut(replicates(records, n, by))
    key = [*by, "replicate"]
    parts = [metrics.macro_f1(cells, key, "weight").select(*key, F.lit("macro_f1").alias("metric"), F.col("macro_f1").alias("v"))]
    parts.append(metrics.mcc(cells, key, "weight").select(*key, F.lit("mcc").alias("metric"), F.col("mcc").alias("v")))
    parts.append(metrics.weighted_kappa(cells, key, "weight").select(*key, F.lit("kappa").alias("metric"), F.col("kappa").alias("v")))
    values = parts[0].unionByName(parts[1]).unionByName(parts[2])
    sorted_ = F.array_sort(F.collect_list(F.when(F.col("replicate") > 0, F.col("v"))))
    own = F.max(F.when(F.col("replicate") == 0, F.col("v")))
    found = values.groupBy(*by, "metric").agg(own.alias("value"), sorted_.alias("vs"))
    at = lambda p: F.when(F.size("vs") > 0, F.element_at("vs", F.greatest(F.lit(1), F.ceil(F.size("vs") * F.lit(p)).cast("int"))))
    return found.select(*by, "metric", "value", at((1 - level) / 2).alias("low"), at((1 + level) / 2).alias("high"))


def pr_points(scores: DataFrame, by: list[str], score: str, positive: str, ranges: int | None = None) -> DataFrame:
    """by, score, n, hits, n_above, hits_above, p: rows and positives of each distinct score and of all that are not lower, p being all positives.

    Equal scores are one point. Distinct scores are dealt by sampled ranges and summed up within each; what earlier ranges have is added from their totals.
    """
    points = scores.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(positive)).alias("hits"))
    ranges = ranges or int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = cut(points.repartitionByRange(ranges, *by, F.desc("score")).withColumn("_p", F.spark_partition_id()))
    totals = laid.groupBy(*by, "_p").agg(F.sum("n").alias("_n"), F.sum("hits").alias("_h"))
    earlier = Window.partitionBy(*by).orderBy("_p")
    before = cut(totals.select(*by, "_p", (F.sum("_n").over(earlier) - F.col("_n")).alias("_n"), (F.sum("_h").over(earlier) - F.col("_h")).alias("_h"), F.sum("_h").over(Window.partitionBy(*by)).alias("p")))
    up = Window.partitionBy(*by, "_p").orderBy(F.desc("score"))
    met = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in [*by, "_p"]]
    joined = laid.withColumns({"n_here": F.sum("n").over(up), "hits_here": F.sum("hits").over(up)}).alias("x").join(before.alias("y"), met)
    return joined.select(*(F.col(f"x.{c}").alias(c) for c in by), "score", "n", "hits", (F.col("_n") + F.col("n_here")).alias("n_above"), (F.col("_h") + F.col("hits_here")).alias("hits_above"), "p")


def average_precision(scores: DataFrame, by: list[str], score: str, positive: str, ranges: int | None = None) -> DataFrame:
    """by, pr_auc, n_positive, n: the area under the precision-recall curve as the mean precision over positives, equal scores being one point; null without positives. Rows without a score do not count."""
    points = pr_points(scores, by, score, positive, ranges)
    area = F.sum(F.col("hits") / F.nullif("p", F.lit(0)) * (F.col("hits_above") / F.col("n_above")))
    return points.groupBy(*by).agg(area.alias("pr_auc"), F.sum("hits").alias("n_positive"), F.sum("n").alias("n"))
