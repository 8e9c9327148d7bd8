"""Chat formatting of reply trees, in DataFrame operations only.

Self-joins double the reach of each node's pointer to an ancestor; from the
leaves down the pointers enumerate all root-to-leaf paths in as many joins as
the depth has binary digits. Branches are ranked by score, and each chosen
path is formatted as one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut, let

#: What opens and closes a turn.
OPEN, SHUT, CLOSE = "<turn ", ">\n", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def thread(rows: DataFrame) -> DataFrame:
    """Rows by turn as a tree without branches: each answers the one before.

    Rows with the same turn go by role and text; null turns come first.
    """
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    node = F.row_number().over(by_turn).cast("long")
    return rows.select("conv_id", node.alias("node"), "role", "text").withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def pointers(tree: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pointers from each node to the ancestor 1, 2, 4, ... steps up, with the score of the nodes below that, and the leaves of conv_id, node, parent, score.

    A parent that isn't there makes a root. Nodes on a cycle, and those whose
    ancestors lead to one, are below no root and no leaf. The joins that double
    pointers end when no pointer is left, or as many as before: each further
    doubling loses the pointers of some node unless only cycles are left.
    """
    nodes = tree.select("conv_id", "node", "parent", "score")
    there = nodes.select(F.col("conv_id").alias("c"), F.col("node").alias("n"))
    links = nodes.join(there, F.expr("conv_id <=> c and parent = n"), "left_semi")
    jumps = [cut(links.select("conv_id", "node", F.col("parent").alias("to"), F.coalesce("score", F.lit(0.0)).alias("sum")))]
    left = jumps[0].count()
    while left:
        last = jumps[-1]
        further = cut(last.alias("a").join(last.alias("b"), F.expr("a.conv_id <=> b.conv_id and a.to = b.node")).select("a.conv_id", "a.node", F.col("b.to").alias("to"), (F.col("a.sum") + F.col("b.sum")).alias("sum")))
        now = further.count()
        if now in (0, left):
            break
        jumps.append(further)
        left = now
    inner = links.select(F.col("conv_id").alias("c"), F.col("parent").alias("n"))
    if left and now:  # what still has pointers hangs on a cycle
        inner = inner.unionByName(further.select(F.col("conv_id").alias("c"), F.col("node").alias("n")))
    return jumps, nodes.join(inner.distinct(), F.expr("conv_id <=> c and node = n"), "left_anti").select("conv_id", F.col("node").alias("leaf"))


def path_scores(tree: DataFrame, jumps: list[DataFrame], leaves: DataFrame) -> DataFrame:
    """conv_id, leaf and score, the sum over the leaf's path: one row for each leaf, which climbs by the longest pointers first."""
    at = leaves.select("conv_id", "leaf", F.col("leaf").alias("node"), F.lit(0.0).alias("score"))
    for jump in reversed(jumps):
        at = (
            at.alias("a").join(jump.alias("j"), F.expr("a.conv_id <=> j.conv_id and a.node = j.node"), "left")
            .select("a.conv_id", "a.leaf", F.coalesce("j.to", "a.node").alias("node"), (F.col("a.score") + F.coalesce("j.sum", F.lit(0.0))).alias("score"))
        )
    root = tree.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.coalesce("score", F.lit(0.0)).alias("own"))
    return at.join(root, F.expr("conv_id <=> c and node = n")).select("conv_id", "leaf", (F.col("score") + F.col("own")).alias("score"))


def paths(jumps: list[DataFrame], leaves: DataFrame) -> DataFrame:
    """conv_id, leaf, node and up (steps from the leaf to the node) for every node on the paths of ``leaves``."""
    reach = leaves.select("conv_id", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k in range(len(jumps) - 1, -1, -1):
        step = F.array(F.struct(F.col("r.node").alias("node"), F.col("r.up").alias("up")), F.struct(F.col("j.to").alias("node"), (F.col("r.up") + (1 << k)).alias("up")))
        reach = (
            reach.alias("r").join(jumps[k].alias("j"), F.expr("r.conv_id <=> j.conv_id and r.node = j.node"), "left")
            .select("r.conv_id", "r.leaf", F.explode(F.filter(step, lambda s: s["node"].isNotNull())).alias("one"))
            .select("conv_id", "leaf", "one.*")
        )
    return reach


def format_trees(tree: DataFrame, branches: int = 1) -> DataFrame:
    """conv_id, branch (rank from 1), leaf, score, formatted, n_turns and loss (spans of code points under the loss mask).

    ``tree`` has conv_id, node, parent, role, text and score; other columns are
    not read. A path's score is the sum of its nodes', null being 0; equal
    scores go by leaf. Null texts and roles are empty; rows without node are
    left out; of rows with one node the least by parent, role, text and score
    stands. Nodes on cycles are on no path, so a conversation without any other
    root has no row. The loss mask covers the texts of assistant turns. A
    conversation's chosen paths come together in one row each, its output,
    however long it is; very long texts are formatted whole, and paths that
    aren't chosen are never listed node by node.
    """
    least = F.min(F.struct("parent", "role", "text", "score")).alias("one")
    tree = cut(tree.filter("node is not null").groupBy("conv_id", "node").agg(least).select("conv_id", "node", "one.*"))
    jumps, leaves = pointers(tree)
    best = (
        path_scores(tree, jumps, leaves).withColumn("branch", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf")))
        .filter(F.col("branch") <= branches)
    )
    best = cut(best)
    every = paths(jumps, best)
    best = best.select(F.col("conv_id").alias("bc"), F.col("leaf").alias("bl"), "branch", F.col("score").alias("total"))
    said = tree.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "role", "text")
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SHUT))
    body = escape(F.col("text"))
    order = Window.partitionBy("conv_id", "branch", "leaf").orderBy(F.desc("up"))
    turns = (
        every.join(best, F.expr("conv_id <=> bc and leaf = bl")).join(said, F.expr("conv_id <=> c and node = n"))
        .select("conv_id", "branch", "leaf", "total", "up", "role", head.alias("head"), body.alias("body"))
        .withColumn("length", (F.length("head") + F.length("body") + len(CLOSE)).cast("long"))
        .withColumn("start", F.sum("length").over(order) - F.col("length") + F.length("head"))
    )
    one = F.struct(-F.col("up"), F.concat("head", "body", F.lit(CLOSE)).alias("turn"), F.when(F.col("role") == "assistant", F.struct("start", (F.col("start") + F.length("body")).alias("end"))).alias("loss"))
    return (
        turns.groupBy("conv_id", "branch", "leaf").agg(F.array_sort(F.collect_list(one)).alias("all"), F.first("total").alias("score"))
        .select(
            "conv_id", "branch", "leaf", "score",
            F.array_join("all.turn", "").alias("formatted"),
            F.size("all").cast("long").alias("n_turns"),
            F.filter("all.loss", lambda x: x.isNotNull()).alias("loss"),
        )
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    parts = F.split(formatted, CLOSE)
    return F.transform(
        F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: let(F.instr(p, F.lit(SHUT)), lambda at: F.struct(
            unescape(F.substring(p, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"),
            unescape(F.substring(p, at + len(SHUT), F.length(p))).alias("text"),
        )),
    )


def under_mask(formatted: Column, loss: Column) -> Column:
    """The text that the loss mask covers, cut from the output and unescaped, span by span with nothing between."""
    cut_out = lambda x: unescape(F.substr(formatted, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))
    return F.array_join(F.transform(loss, cut_out), "")


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what is read back from ``formatted``, and of what its loss mask covers."""
    rows = formatted.withColumn("turns", read_back(F.col("formatted"))).withColumn("learnt", under_mask(F.col("formatted"), F.col("loss")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
