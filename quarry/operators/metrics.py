"""Evaluation metrics over prediction records (tool, variant, sample_id, ground_truth, predicted).

All metrics of a (tool, variant) come from one pass over records exploded by label, or from small confusion tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K

BY = ["tool", "variant"]


def _depths() -> tuple[dict[str, list[str]], dict[tuple[str, str], float]]:
    up = dict(TREE_PARENTS)
    chains = {}
    for node in {n for edge in K.TREE for n in edge} - {"ROOT"}:
        chain = [node]
        while chain[-1] in up:
            chain.append(up[chain[-1]])
        chains[node] = chain
    table = {}
    for a in chains:
        for b in chains:
            low = next(x for x in chains[a] if x in chains[b])
            depth = lambda n: len(chains[n]) - 1 if n != "ROOT" else 0
            table[a, b] = 1.0 if a == b else 0.0 if low == "ROOT" else 2.0 * depth(low) / (depth(a) + depth(b))
    return chains, table


TREE_PARENTS = K.TREE
#: Wu-Palmer similarity of each pair of classes of the tree.
SIMILARITY = {(f"CWE-{a}", f"CWE-{b}"): v for (a, b), v in _depths()[1].items()}


def similarity(a: Column, b: Column) -> Column:
    """Wu-Palmer similarity of two classes; null outside the tree."""
    pairs = F.create_map(*(x for (p, q), v in SIMILARITY.items() if p in K.TARGETS and q in K.TARGETS for x in (F.lit(f"{p}|{q}"), F.lit(v))))
    return F.try_element_at(pairs, F.concat(a, F.lit("|"), b))


def tree_closure(spark: SparkSession) -> DataFrame:
    """(node, ancestor, up) of the class tree, by a recursive query."""
    edges = ", ".join(f"('{c}', '{p}')" for c, p in K.TREE)
    return spark.sql(f"""
        WITH RECURSIVE edges(child, parent) AS (VALUES {edges}),
        up(node, ancestor, up) AS (
          SELECT child, child, 0 FROM edges UNION ALL
          SELECT up.node, edges.parent, up.up + 1 FROM up JOIN edges ON up.ancestor = edges.child)
        SELECT node, ancestor, up FROM up""")


def wu_palmer(spark: SparkSession) -> DataFrame:
    """(a, b, similarity) of all target classes, from the closure of the tree."""
    up = tree_closure(spark)
    depth = up.groupBy("node").agg(F.max("up").alias("depth"))
    own = up.filter(F.col("node").isin([t.removeprefix("CWE-") for t in K.TARGETS]))
    a = own.select(F.col("node").alias("a"), "ancestor")
    b = own.select(F.col("node").alias("b"), "ancestor")
    at = depth.select(F.col("node").alias("ancestor"), F.col("depth").alias("low"))
    met = a.join(b, "ancestor").join(at, "ancestor", "left").groupBy("a", "b").agg(F.max(F.coalesce("low", F.lit(0))).alias("low"))
    da, db = depth.select(F.col("node").alias("a"), F.col("depth").alias("da")), depth.select(F.col("node").alias("b"), F.col("depth").alias("db"))
    value = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0 * F.col("low") / (F.col("da") + F.col("db")))
    return met.join(da, "a").join(db, "b").select(F.concat(F.lit("CWE-"), "a").alias("a"), F.concat(F.lit("CWE-"), "b").alias("b"), value.alias("similarity"))


def _n(condition: Column, weight: str | None) -> Column:
    """How many rows fulfil a condition, each counting as often as its weight says, if there is one."""
    return F.count_if(condition) if weight is None else F.sum(F.when(condition, F.col(weight)).otherwise(0))


def confusion(records: DataFrame, by: list[str] = BY, weight: str | None = None) -> DataFrame:
    """by, cwe, tp, fp, fn, tn: one-vs-rest counts of each target class; weight: a column that says how often a record counts."""
    rows = records.select(*by, "ground_truth", "predicted", *([weight] if weight else []), F.explode(F.array(*map(F.lit, K.TARGETS))).alias("cwe"))
    truth, said = F.col("ground_truth") == F.col("cwe"), F.array_contains("predicted", F.col("cwe"))
    return rows.groupBy(*by, "cwe").agg(_n(truth & said, weight).alias("tp"), _n(~truth & said, weight).alias("fp"), _n(truth & ~said, weight).alias("fn"), _n(~truth & ~said, weight).alias("tn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_scores(cells: DataFrame) -> DataFrame:
    """cells with precision, recall, f1 (0 where undefined), support and present (as a label or a prediction)."""
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return cells.withColumns({"precision": p, "recall": r, "f1": _ratio(2 * p * r, p + r), "support": F.col("tp") + F.col("fn"), "present": F.col("tp") + F.col("fn") + F.col("fp") > 0})


def macro_f1(records: DataFrame, by: list[str] = BY, weight: str | None = None) -> DataFrame:
    scored = class_scores(confusion(records, by, weight))
    return scored.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col("present"), F.col("f1"))), F.lit(0.0)).alias("macro_f1"))


def binary(records: DataFrame, by: list[str] = BY, weight: str | None = None) -> DataFrame:
    """by, tp, fp, fn, tn of any prediction against any vulnerability."""
    truth, said = F.col("ground_truth") != "safe", F.size("predicted") > 0
    return records.groupBy(*by).agg(_n(truth & said, weight).alias("tp"), _n(~truth & said, weight).alias("fp"), _n(truth & ~said, weight).alias("fn"), _n(~truth & ~said, weight).alias("tn"))


def mcc(records: DataFrame, by: list[str] = BY, weight: str | None = None) -> DataFrame:
    """Matthews correlation; null if a class is absent or all answers are alike."""
    d = {c: F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn")}
    base = (d["tp"] + d["fp"]) * (d["tp"] + d["fn"]) * (d["tn"] + d["fp"]) * (d["tn"] + d["fn"])
    return binary(records, by, weight).withColumn("mcc", F.try_divide(d["tp"] * d["tn"] - d["fp"] * d["fn"], F.sqrt(F.nullif(base, F.lit(0.0)))))


def severity_weighted_recall(records: DataFrame, scores: DataFrame, by: list[str] = BY) -> DataFrame:
    """by, swr, pool, excluded: recall of vulnerable rows weighted by their score (sample_id, score); rows without a positive score are excluded."""
    fine = scores.filter("score > 0").select("sample_id", "score")
    rows = records.filter("ground_truth <> 'safe'").join(fine, "sample_id", "left")
    hit = F.sum(F.when(F.size("predicted") > 0, F.col("score")))
    return rows.groupBy(*by).agg(_ratio(F.coalesce(hit, F.lit(0.0)), F.coalesce(F.sum("score"), F.lit(0.0))).alias("swr"), F.count("score").alias("pool"), F.count_if(F.col("score").isNull()).alias("excluded"))


def best_similarity(predicted: Column, truth: Column) -> Column:
    """The greatest similarity of a predicted class to the truth; 0 if nothing (known) is predicted."""
    return F.coalesce(F.array_max(F.transform(predicted, lambda p: similarity(p, truth))), F.lit(0.0))


def hcma(records: DataFrame, by: list[str] = BY) -> DataFrame:
    """Hierarchical macro accuracy: mean best similarity of each true class, averaged over classes."""
    rows = records.filter(F.col("ground_truth").isin(K.TARGETS)).select(*by, "ground_truth", best_similarity(F.col("predicted"), F.col("ground_truth")).alias("s"))
    return rows.groupBy(*by, "ground_truth").agg(F.avg("s").alias("s")).groupBy(*by).agg(F.avg("s").alias("hcma"))


def verdict(predicted: Column) -> Column:
    """The first predicted label of the label space, else safe."""
    return F.coalesce(F.try_element_at(F.filter(predicted, lambda p: p.isin(K.LABELS)), F.lit(1)), F.lit("safe"))


def disagreement(a: Column, b: Column) -> Column:
    return F.when(a == b, 0.0).when((a == "safe") | (b == "safe"), 1.0).otherwise(1 - similarity(a, b))


def weighted_kappa(records: DataFrame, by: list[str] = BY, weight: str | None = None) -> DataFrame:
    """by, kappa, observed_agreement, n: chance-corrected agreement with tree-based weights; null if chance disagreement is 0."""
    truth = F.when(F.col("ground_truth").isin(K.LABELS), F.col("ground_truth")).otherwise("safe")
    cells = records.groupBy(*by, truth.alias("a"), verdict(F.col("predicted")).alias("b")).agg(_n(F.lit(True), weight).alias("n"))
    rows = cells.groupBy(*by, "a").agg(F.sum("n").alias("na"))
    columns = cells.groupBy(*by, "b").agg(F.sum("n").alias("nb"))
    w = disagreement(F.col("a"), F.col("b"))
    seen = cells.groupBy(*by).agg(F.sum(w * F.col("n")).alias("o"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"), F.sum("n").alias("n"))
    chance = rows.join(columns, by).groupBy(*by).agg(F.sum(w * F.col("na") * F.col("nb")).alias("e"))
    both = seen.join(chance, by)
    return both.select(*by, (1 - F.try_divide(F.col("o"), F.nullif(F.col("e") / F.col("n"), F.lit(0.0)))).alias("kappa"), (F.col("same") / F.col("n")).alias("observed_agreement"), "n")


def robustness_drop(records: DataFrame, clean: str = "clean") -> DataFrame:
    """tool, variant, macro_f1_clean, macro_f1, drop: the clean score restricted to the ids of each other variant."""
    other = records.filter(F.col("variant") != clean)
    ids = other.select("tool", "variant", "sample_id").distinct()
    base = records.filter(F.col("variant") == clean).drop("variant").join(ids, ["tool", "sample_id"])
    was = macro_f1(base).withColumnRenamed("macro_f1", "macro_f1_clean")
    return was.join(macro_f1(other), BY).withColumn("drop", F.col("macro_f1_clean") - F.col("macro_f1"))


def mean_single_drop(drops: DataFrame) -> DataFrame:
    """tool, mean_drop over the single mutators that are present; null without any."""
    return drops.groupBy("tool").agg(F.avg(F.when(F.col("variant").isin(K.MUTATORS), F.col("drop"))).alias("mean_drop"))


def score_bundle(records: DataFrame, scores: DataFrame) -> DataFrame:
    """All metrics of each tool and variant in one row."""
    out = macro_f1(records)
    for part in (mcc(records).select(*BY, "mcc"), severity_weighted_recall(records, scores), hcma(records), weighted_kappa(records)):
        out = out.join(part, BY, "left")
    return out


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share; null without trials."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = hits / n
    middle, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return middle - half, middle + half


def regression_errors(df: DataFrame, predicted: str, target: str, by: list[str]) -> DataFrame:
    """MAE, RMSE and count over rows with a target."""
    d = F.when(F.col(target).isNotNull(), F.col(predicted) - F.col(target))
    return df.groupBy(*by).agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.count(d).alias("n"))


def argmax_scores(df: DataFrame, by: list[str]) -> DataFrame:
    """Macro and per-class F1 of single labels (y, yhat) over classes seen in either."""
    long = df.select(*by, "y", "yhat", F.explode(F.array_distinct(F.array("y", "yhat"))).alias("label"))
    t, s = F.col("y") == F.col("label"), F.col("yhat") == F.col("label")
    cells = long.groupBy(*by, "label").agg(F.count_if(t & s).alias("tp"), F.count_if(~t & s).alias("fp"), F.count_if(t & ~s).alias("fn"))
    f1 = _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return cells.withColumn("f1", f1)
