"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions alone.

A token budget runs down a tree such as domain, language, source: each node's budget is shared among its children by weight, and what a child
cannot hold goes to its siblings; as a node never gets more than all below it can hold, a shortage reaches siblings before ancestors. Each leaf then takes
whole epochs of its documents and a prefix of one more epoch in seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, sized_join

#: Hexadecimal digits of the order key that name a bucket: a leaf's documents lie in up to 16^3 of them.
BUCKET_DIGITS = 3
WORD = "[^ \\t\\n\\x0B\\f\\r]+"


def count_tokens(text: Column) -> Column:
    """Words without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")

def _share(nodes: DataFrame) -> DataFrame:
    """Adds budget to nodes (parent, node, weight, cap, total): total is the parent's budget; weights fill up to caps."""
    by = Window.partitionBy("parent")
    order = by.orderBy(F.col("fill"), "node")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    n = nodes.withColumn("fill", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    n = n.withColumn("weight_left", F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    n = n.withColumn("total_left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    n = n.withColumn("full", (F.col("weight") > 0) & (F.col("cap") * F.col("weight_left") <= F.col("weight") * F.col("total_left") * (1 + 1e-12)))
    spent = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(by)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(by)
    part = F.col("weight") * F.greatest(F.col("total") - spent, F.lit(0.0)) / open_weight
    return n.withColumn("budget", F.when(F.col("full"), F.col("cap")).when(open_weight > 0, F.least(part, F.col("cap"))).otherwise(0.0)).drop("fill", "weight_left", "total_left", "full")


def leaf_budgets(leaves: DataFrame, depth: int, weights: dict[tuple, float], fraction: float, max_epochs: int) -> DataFrame:
    """(leaf, tokens, budget): whole tokens that each leaf contributes.

    leaves: leaf, path (its levels), tokens. A node's weight is weights[path] or, for all nodes of a level, weights[(None,) * (depth - 1) + (name,)]; 1 by default.
    A weight of 0 leaves a node out. The whole budget is fraction of all tokens, as far as max_epochs of each leaf reach.
    """
    table = {k: float(v) for k, v in weights.items()}
    exact = F.create_map(*(F.lit(x) for k, v in table.items() if None not in k[:-1] for x in ("/".join(map(str, k)), v))) if table else F.create_map().cast("map<string,double>")
    anywhere = {(len(k), str(k[-1])): v for k, v in table.items() if None in k[:-1]}
    loose = F.create_map(*(F.lit(x) for (n, name), v in anywhere.items() for x in (f"{n}/{name}", v))) if anywhere else F.create_map().cast("map<string,double>")
    rows = leaves
    for d in range(1, depth + 1):
        named = F.array_join(F.slice("path", 1, d), "/", "∅")
        last = F.concat(F.lit(f"{d}/"), F.coalesce(F.element_at("path", d), F.lit("∅")))
        rows = rows.withColumn(f"n{d}", F.to_json(F.slice("path", 1, d), {"ignoreNullFields": "false"})).withColumn(f"w{d}", F.coalesce(F.try_element_at(exact, named), F.try_element_at(loose, last), F.lit(1.0)))
    kept = F.lit(True)
    for d in range(1, depth + 1):
        kept = kept & (F.col(f"w{d}") > 0)
    rows = cut(rows.withColumn("cap", F.when(kept, F.col("tokens") * float(max_epochs)).otherwise(0.0)))
    above = rows.agg(F.least(F.sum("tokens") * fraction, F.sum("cap")).alias("budget")).select(F.lit("[]").alias("node"), F.coalesce("budget", F.lit(0.0)).alias("budget"))
    for d in range(1, depth + 1):
        parent = F.col(f"n{d - 1}") if d > 1 else F.lit("[]")
        nodes = rows.groupBy(parent.alias("parent"), F.col(f"n{d}").alias("node"), F.col(f"w{d}").alias("weight")).agg(F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("weight", F.when(F.col("cap") > 0, F.col("weight")).otherwise(0.0))
        above = cut(_share(nodes.join(above.select(F.col("node").alias("parent"), F.col("budget").alias("total")), "parent")))
    return rows.join(above.select(F.col("node").alias(f"n{depth}"), "budget"), f"n{depth}").select("leaf", "tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def _order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[tuple, float], fraction: float = 0.5, max_epochs: int = 2, seed: int = 1, doc_id: str = "doc_id", text: str = "text", prefix: str = "_") -> DataFrame:
    """The documents of a mix: docs' columns and, after prefix, path (names of its tree nodes), epoch, n_tokens, used_tokens.

    levels: the tree's levels from the top, as columns of docs. A leaf with budget b and t tokens gives b // t whole epochs and then, in the order of a seeded hash of the id (a new one for
    each epoch), the documents before its remaining budget is used up; of the last one only used_tokens are in the mix. A leaf's used tokens sum up to its budget. Null levels
    are nodes of their own; a null or empty text has 0 tokens and comes with whole epochs and within prefixes; a null id orders as an empty one;
    rows that repeat an id are ordered by their tokens and then by a hash of all their columns; repeated rows each count, and texts of any length are counted whole. An empty table gives no rows. Columns of docs may have any names; one with the name of a made column is replaced.
    """
    path, row = F.array(*(c.cast("string") for c in levels.values())), F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    own = [F.col(f"`{doc_id}`").alias("id"), path.alias("path"), F.to_json(path, {"ignoreNullFields": "false"}).alias("leaf"), count_tokens(F.col(f"`{text}`")).alias("n_tokens")]
    base = docs.select(row.alias("row"), *own)
    # texts are read once for their sizes, and again for the result
    sizes = cut(docs.select(*own))
    leaves = cut(sizes.groupBy("leaf").agg(F.first("path").alias("path"), F.sum("n_tokens").alias("tokens")))
    budgets = leaf_budgets(leaves, len(levels), weights, fraction, max_epochs).filter("tokens > 0")
    whole = F.floor(F.col("budget") / F.col("tokens")).cast("long")
    plan = cut(budgets.select("leaf", whole.alias("whole"), (F.col("budget") - whole * F.col("tokens")).alias("rest")))
    key = _order_key(seed, F.col("whole"), F.col("id"))
    partial = sized_join(sizes.select("id", "leaf", "n_tokens"), plan.filter("rest > 0"), "leaf", "inner", 200)
    sums = partial.groupBy("leaf", "rest", F.substring(key, 1, BUCKET_DIGITS).alias("edge")).agg(F.sum("n_tokens").alias("n"))
    until = F.sum("n").over(Window.partitionBy("leaf").orderBy("edge"))
    edge = sums.withColumn("until", until).filter((F.col("until") - F.col("n") < F.col("rest")) & (F.col("until") >= F.col("rest"))).select("leaf", "edge", (F.col("until") - F.col("n")).alias("before"))
    plan = cut(plan.join(edge, "leaf", "left"))
    bucket = F.substring(key, 1, BUCKET_DIGITS)
    rows = sized_join(base, plan, "leaf", "inner", 200)
    out = ["row", "path", "epoch", "n_tokens", "used_tokens"]
    use = "array<struct<epoch:bigint,used_tokens:bigint>>"
    every = F.when(F.col("whole") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1), lambda e: F.struct(e.alias("epoch"), F.col("n_tokens").alias("used_tokens")))).otherwise(F.array().cast(use))
    early = F.when((F.col("rest") > 0) & (bucket < F.col("edge")), F.array(F.struct(F.col("whole").alias("epoch"), F.col("n_tokens").alias("used_tokens")))).otherwise(F.array().cast(use))
    most = rows.withColumn("use", F.explode(F.concat(every, early))).select("row", "path", "use.epoch", "n_tokens", "use.used_tokens")
    # rows of one order key, such as those without an id, are told apart by size and text
    near = Window.partitionBy("leaf").orderBy("key", "id", "n_tokens", F.xxhash64(F.to_json("row"))).rowsBetween(Window.unboundedPreceding, -1)
    last = rows.filter((F.col("rest") > 0) & (bucket == F.col("edge"))).withColumn("key", key)
    last = last.withColumn("left", F.col("rest") - F.col("before") - F.coalesce(F.sum("n_tokens").over(near), F.lit(0))).filter("left > 0")
    last = last.withColumns({"epoch": F.col("whole"), "used_tokens": F.least("n_tokens", "left")}).select(out)
    names = [f"{prefix}{m}" for m in out[1:]]
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in names]
    return most.unionByName(last).select(*kept, *(F.col(c).alias(n) for c, n in zip(out[1:], names, strict=True)))
