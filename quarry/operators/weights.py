"""Class weights, margins, sampling weights and training tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K



def _all():
    return Window.partitionBy()


def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("cwe").agg(F.count(F.lit(1)).alias("n"))


def with_label_order(spark: SparkSession, counts: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Counts of every label in order, 0 where a label has no row."""
    order = spark.createDataFrame(list(enumerate(labels or K.LABELS)), "position int, cwe string")
    return order.join(counts, "cwe", "left").select("position", "cwe", F.coalesce("n", F.lit(0)).alias("n"))


def effective_number(counts: DataFrame, beta: float = 0.999) -> DataFrame:
    """counts with weight: (1 - beta) / (1 - beta^n), 0 for n = 0, scaled so that weights of all classes sum up to their number. One row per class."""
    raw = F.when(F.col("n") > 0, (1 - beta) / (1 - F.pow(F.lit(beta), F.col("n")))).otherwise(0.0)
    w = counts.withColumn("_raw", raw)
    total, k = F.sum("_raw").over(_all()), F.count(F.lit(1)).over(_all())
    return w.withColumn("weight", F.when(total > 0, F.col("_raw") * k / total).otherwise(0.0)).drop("_raw")


def ldam_margins(counts: DataFrame, top: float = 0.5) -> DataFrame:
    """counts with margin: proportional to n^(-1/4) (n at least 1), the greatest being top."""
    raw = counts.withColumn("_raw", 1 / F.pow(F.greatest(F.col("n"), F.lit(1)).cast("double"), F.lit(0.25)))
    return raw.withColumn("margin", F.col("_raw") * top / F.max("_raw").over(_all())).drop("_raw")


def multiplier(cwe: Column, table: dict[str, float] | None = None, default: float = 1.0) -> Column:
    table = K.MULTIPLIERS if table is None else table
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), cwe), F.lit(default))


def oversample(df: DataFrame, table: dict[str, float] | None = None) -> DataFrame:
    """Each row as many times as its class's multiplier says (at least once), with copy_index."""
    times = F.greatest(F.floor(multiplier(F.col("cwe"), table)), F.lit(1)).cast("int")
    return df.withColumn("copy_index", F.explode(F.sequence(F.lit(1), times)))


def weighted_draws(df: DataFrame, draws: int, seed: int, key: str = "id", weight: str = "weight") -> DataFrame:
    """Sampling with replacement: each row with the number of times it is drawn when its share of all weight is rounded up or down by a seeded hash.

    The expected number is exact and no global order is needed, so that it runs at any size.
    """
    total = df.agg(F.sum(weight).alias("_total"))
    want = F.col(weight) / F.col("_total") * draws
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    return df.join(F.broadcast(total)).withColumn("times", (F.floor(want) + (u < want - F.floor(want)).cast("int")).cast("long")).drop("_total")


def target_summary(targets: DataFrame) -> DataFrame:
    """what, key, n of severity targets (id, content_hash, score, score_source, confidence, and whole: whether all parts of a vector are known).

    The total counts distinct keys, the content hash or else the id; the coverages, sources and confidences count every row that has a key, as rows of one content are counted each.
    """
    rows = targets.withColumn("_key", F.coalesce(F.nullif("content_hash", F.lit("")), F.nullif("id", F.lit("")))).filter("_key is not null")
    total = rows.agg(F.countDistinct("_key").alias("n")).select(F.lit("total").alias("what"), F.lit("all").alias("key"), "n")
    one = lambda what, key, on: F.struct(F.lit(what).alias("what"), key.alias("key"), on.alias("on"))
    every = F.array(one("score_coverage", F.lit("all"), F.col("score").isNotNull()), one("subvector_coverage", F.lit("all"), F.col("whole")), one("score_source", F.col("score_source"), F.lit(True)), one("confidence", F.col("confidence"), F.lit(True)))
    counted = rows.select(F.explode(every).alias("x")).select("x.*").groupBy("what", "key").agg(F.count_if("on").alias("n"))
    return total.unionByName(counted)


def weight_schedule(spark: SparkSession, counts: DataFrame, labels: list[str] | None = None, beta: float = 0.999, top: float = 0.5, epochs: int = 10, share: float = 0.8) -> DataFrame:
    """position, cwe, n, phase, first_epoch, n_epochs, weight, margin: each label in order, with 0 where it has no rows, in two phases: uniform weights first, weights by effective numbers then."""
    first, second = drw_phases(epochs, share)
    every = ldam_margins(effective_number(with_label_order(spark, counts, labels), beta), top)
    phase = lambda name, at, n, w: F.struct(F.lit(name).alias("phase"), F.lit(at).alias("first_epoch"), F.lit(n).alias("n_epochs"), w.alias("weight"))
    phases = F.array(phase("uniform", 0, first, F.lit(1.0)), phase("effective_number", first, second, F.col("weight")))
    return every.select("position", "cwe", "n", "margin", F.explode(phases).alias("x")).select("position", "cwe", "n", "x.*", "margin")


def drw_phases(total: int = 10, share: float = 0.8) -> tuple[int, int]:
    first = int(round(total * share))
    return first, total - first


def nll(mu: Column, log_variance: Column, y: Column) -> Column:
    """Heteroscedastic negative log likelihood of a row."""
    return 0.5 * F.exp(-log_variance) * F.pow(y - mu, F.lit(2.0)) + 0.5 * log_variance


def feature_rows(samples: DataFrame) -> DataFrame:
    """Class index (unknown classes are safe) of each row for training tables."""
    at = F.create_map(*(x for i, c in enumerate(K.LABELS) for x in (F.lit(c), F.lit(i))))
    return samples.withColumn("class_index", F.coalesce(F.try_element_at(at, F.col("cwe")), F.lit(len(K.LABELS) - 1)))


def ldam_loss(logits: Column, label: Column, margins: Column, scale: float = 30.0) -> Column:
    """Cross entropy of scaled logits (an array) with the label's margin taken from its own logit; label counts from 0."""
    moved = F.transform(logits, lambda x, i: (F.when(i == label, x - F.get(margins, i)).otherwise(x)) * scale)
    top = F.array_max(moved)
    total = F.aggregate(F.transform(moved, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return F.ln(total) + top - F.get(moved, label)


def supcon_loss(rows: DataFrame, temperature: float = 0.07) -> DataFrame:
    """batch, loss: supervised contrastive loss over the vectors (id, batch, label, v) of each batch; rows without another of their label do not count."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = rows.select("id", "batch", "label", F.transform("v", lambda x: x / length).alias("v"))
    other = unit.select("batch", F.col("id").alias("o"), F.col("label").alias("ol"), F.col("v").alias("ov"))
    dot = F.aggregate(F.zip_with("v", "ov", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / temperature
    pairs = unit.join(other, "batch").filter("id <> o").select("batch", "id", (F.col("label") == F.col("ol")).alias("same"), dot.alias("s"))
    by = pairs.groupBy("batch", "id").agg(F.max("s").alias("top"))
    parts = pairs.join(by, ["batch", "id"]).groupBy("batch", "id", "top").agg(F.ln(F.sum(F.exp(F.col("s") - F.col("top")))).alias("log"), F.avg(F.when(F.col("same"), F.col("s"))).alias("mean"))
    return parts.filter("mean is not null").groupBy("batch").agg(F.avg(F.col("log") + F.col("top") - F.col("mean")).alias("loss"))


def training_examples(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """sample_id, class_index, sub_labels, cvss_score, loss_weight, is_hard_negative of rows (id, cwe, content_hash, is_hard_negative).

    targets (key, letters: struct of metric letters or null, score, loss_weight) are looked up by content hash, or by id for rows without one. A class that is not known is safe; a metric without a valid
    letter has IGNORE_INDEX, a missing score is NaN, a missing weight 0.
    """
    found = rows.withColumn("key", F.coalesce(F.nullif("content_hash", F.lit("")), "id")).join(targets, "key", "left")
    place = lambda k, letters: F.when(F.length(F.col(f"letters.{k}")) == 1, F.nullif(F.instr(F.lit(letters), F.col(f"letters.{k}")), F.lit(0)) - 1)
    labels = F.array(*(F.coalesce(place(k, v), F.lit(K.IGNORE_INDEX)).cast("int") for k, v in K.CVSS_LETTERS.items()))
    out = feature_rows(found)
    score, weight = F.coalesce("score", F.lit(float("nan"))), F.coalesce("loss_weight", F.lit(0.0))
    return out.select(F.col("id").alias("sample_id"), "class_index", labels.alias("sub_labels"), score.alias("cvss_score"), weight.alias("loss_weight"), F.coalesce("is_hard_negative", F.lit(False)).alias("is_hard_negative"))


def draws_with_replacement(df: DataFrame, draws: int, seed: int, key: str = "id", weight: str = "weight") -> DataFrame:
    """key, times: how often each row is drawn in as many independent draws by weight; rows that are never drawn, and those without a key or a positive weight, are left out.

    Weights are summed up in the order of hashed keys, by ranges of hashes first; a draw is a hashed point, and points and rows meet in cells of the whole length.
    """
    rows = df.filter(F.col(key).isNotNull() & (F.col(weight) > 0)).select(F.col(key).alias("id"), F.col(weight).cast("double").alias("w"), F.sha2(F.col(key).cast("string"), 256).alias("h"))
    rows = rows.withColumn("range", F.substring("h", 1, 3))
    sums = rows.groupBy("range").agg(F.sum("w").alias("s"))
    before = sums.select("range", (F.sum("s").over(Window.orderBy("range")) - F.col("s")).alias("before"))
    total = sums.agg(F.sum("s")).first()[0]
    if not total or draws < 1:
        return rows.limit(0).select(F.col("id").alias(key), F.lit(0).cast("long").alias("times"))
    near = Window.partitionBy("range").orderBy("h", "id")
    placed = rows.join(F.broadcast(before), "range").withColumn("hi", F.col("before") + F.sum("w").over(near)).withColumn("lo", F.col("hi") - F.col("w"))
    cell = total / max(1, draws // 256)
    spans = placed.select("id", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))).alias("cell"))
    point = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("j").cast("string")), 256), 1, 13), 16, 10).cast("double") / float(16**13) * total
    points = df.sparkSession.range(draws).select(F.col("id").alias("j")).select("j", point.alias("u")).withColumn("cell", F.floor(F.col("u") / cell))
    hit = points.join(spans, "cell").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    return hit.groupBy("id").agg(F.count(F.lit(1)).alias("times")).select(F.col("id").alias(key), "times")
