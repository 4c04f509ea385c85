"""Chat formatting of reply trees with DataFrame functions alone.

Messages with a parent form trees. Self-joins that double the distance sum up the scores of every leaf's path, by which branches are ranked within their tree, and enumerate the
messages of each chosen path, so that a path of length n takes about log2(n) joins; each chosen path becomes one string with marked turns and the spans that the loss covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: Fixed values of the chat template.
START, END = "<|im_start|>", "<|im_end|>"


def escape_text(text: Column) -> Column:
    """One more backslash between each '<' and '|' that have none or only backslashes between them: no marker is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles stand on one line: per cent, line feed and '<' are written as per cent codes."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def leaf_paths(messages: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(leaf, node, up): every ancestor of every leaf, or of the leaves in chosen (leaf) alone, up being the distance from the leaf (0: itself).

    messages has node (unique, not null) and parent. Round r joins the pairs known so far with jumps over 2^r
    messages, so there are as many rows as the paths have messages. A parent that is not among the messages makes its child a root.
    Messages on a cycle have neither leaf nor root; a leaf whose ancestors run into a cycle is left out.
    """
    nodes = cut(messages.select("node", "parent"))
    rounds = nodes.count().bit_length()
    jumps = cut(nodes.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", "parent"))
    leaves = nodes.join(jumps.select(F.col("parent").alias("node")), "node", "left_anti").select(F.col("node").alias("leaf")) if chosen is None else chosen.select("leaf")
    paths = cut(leaves.select("leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up")))
    for r in range(rounds):
        if jumps.isEmpty():
            return paths
        more = paths.join(jumps, "node").select("leaf", F.col("parent").alias("node"), (F.col("up") + (1 << r)).alias("up"))
        paths = cut(paths.unionByName(more))
        onward = jumps.select(F.col("node").alias("parent"), F.col("parent").alias("over"))
        jumps = cut(jumps.join(onward, "parent").select("node", F.col("over").alias("parent")))
    looped = jumps.select(F.col("node").alias("leaf"))
    return paths.join(looped, "leaf", "left_anti")


def leaf_scores(messages: DataFrame) -> DataFrame:
    """(leaf, tree, score) of every leaf: the scores of its path, summed up along jumps that double, one row a message in each round.

    messages: node (unique, not null), parent, tree, score. A tree's only leaf is not summed, and has a null score. Leaves whose ancestors run into a cycle are left out where scores are summed.
    """
    parents = messages.select(F.col("parent").alias("node")).distinct()
    leaves = cut(messages.select("node", "tree").join(parents, "node", "left_anti").select(F.col("node").alias("leaf"), "tree"))
    rivals = cut(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("tree").alias("rival")))
    if rivals.isEmpty():
        return leaves.withColumn("score", F.lit(None).cast("double"))
    there = messages.select(F.col("node").alias("parent"), F.lit(True).alias("on"))
    state = messages.select("node", "parent", "score").join(there, "parent", "left")
    state = cut(state.select("node", F.when(F.col("on"), F.col("parent")).alias("at"), F.col("score").alias("total")))
    for _ in range(messages.count().bit_length()):
        if state.filter("at is not null").isEmpty():
            break
        onward = state.select(F.col("node").alias("at"), F.col("at").alias("over"), F.col("total").alias("more"))
        moved = state.filter("at is not null").join(onward, "at").select("node", F.col("over").alias("at"), (F.col("total") + F.col("more")).alias("total"))
        state = cut(moved.unionByName(state.filter("at is null")))
    scores = state.filter("at is null").select(F.col("node").alias("leaf"), F.col("total").alias("score"))
    return leaves.join(scores, "leaf")


def format_chats(messages: DataFrame, max_branches: int = 1) -> DataFrame:
    """The best branches of each reply tree as training texts: tree, branch, n_turns, formatted, loss_spans.

    messages: tree, node, parent, role, text, score (null: 0); other columns are ignored. A tree's branches are its
    root-to-leaf paths; they are ranked by the sum of their scores (then by leaf) and the first max_branches are
    kept. Null roles and texts count as empty; of rows with the same node the smallest counts; rows without a node are no message.
    loss_spans holds (start, length) in code points, start from 0, of each assistant text as written, in order. An empty table gives no rows.
    """
    body = F.struct(F.col("parent"), F.col("tree"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    single = cut(messages.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min(body).alias("m")).select("node", "m.*"))
    best = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    chosen = cut(leaf_scores(single).withColumn("branch", F.row_number().over(best)).filter(F.col("branch") <= max_branches).select("leaf", "tree", "branch"))
    # leaves are ranked before their paths are listed, so that only the chosen paths are ever rows
    paths = leaf_paths(single, chosen)
    turns = paths.join(chosen.select("leaf", "tree", "branch"), "leaf").join(single.select("node", "role", "text"), "node")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = turns.select("leaf", "tree", "branch", "role", (-F.col("up")).alias("at"), head.alias("head"), escape_text(F.col("text")).alias("body"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("leaf", "tree", "branch").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    turns = turns.select("leaf", "tree", "branch", F.struct("at", "role", "piece", start.alias("start"), F.length("body").cast("long").alias("length")).alias("t"))
    whole = turns.groupBy("leaf", "tree", "branch").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    lost = F.transform(F.filter("ts", lambda t: t.role == "assistant"), lambda t: F.struct(t.start.alias("start"), t.length.alias("length")))
    return whole.select("tree", "branch", F.size("ts").cast("long").alias("n_turns"), F.array_join(F.transform("ts", lambda t: t.piece), "").alias("formatted"), lost.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted text, as they were before escaping."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")
    turn = r"(?s)^<\|im_start\|>([^\n]*)\n(.*)$"
    return F.transform(parts, lambda x: F.struct(unescape_role(F.regexp_extract(x, turn, 1)).alias("role"), unescape_text(F.regexp_extract(x, turn, 2)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape_text(F.substr(formatted, (s.start + 1).cast("int"), s.length.cast("int")))), "")


def linear_messages(rows: DataFrame) -> DataFrame:
    """Reply trees of plain conversations (conv_id, turn, role, text): each turn answers the one before it.

    Turns of one number follow by role and text; a null conversation id is a conversation of its own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(order))
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    return rows.select(F.col("conv_id").alias("tree"), F.concat_ws(":", name, F.col("n")).alias("node"), F.when(F.col("n") > 1, F.concat_ws(":", name, F.col("n") - 1)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
