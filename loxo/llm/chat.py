"""Chat formatting over reply trees.

Messages hang in trees by (tree, node, parent).  Self-joins that double their
reach enumerate each root-to-leaf path: after k rounds a leaf knows all its
ancestors fewer than 2**k steps away, so a thread of n turns takes log2(n)
rounds and as many rows as its paths have messages.  Only ids and scores take
part in the joins.  Branches are ranked within their tree by mean score, then
by length and leaf; the first ``branches`` of each are formatted.

Template, per turn: ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside texts a
backslash becomes ``\\b`` and ``<|`` becomes ``\\l|``, so no control string
survives there and the way back is exact; in roles ``%``, line feeds and ``<|``
are percent-coded.  The loss mask lists the spans (code points in the formatted
text) of the assistant's escaped texts.

Defined cases: null text is empty, null role is an empty role; rows of equal
turn are put in order of role, then text, and repeated rows stay; a parent that
isn't there makes its child a root; messages whose parents lead into a cycle
have no root and are not formatted; (tree, node) names a message; null conv_id
is a conversation of its own; an empty table gives an empty result; columns
other than those named are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

START, END = "<|im_start|>", "<|im_end|>"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("\\l|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<|"), F.lit("%3C|"))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def linear_threads(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows of conversations as trees of one branch: tree, node, parent, role, text, score."""
    w = Window.partitionBy(conv).orderBy(turn, "role", "text")
    df = rows.select(F.col(conv).alias("tree"), F.row_number().over(w).alias("node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return df.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(1.0))


def branch_paths(messages: DataFrame) -> DataFrame:
    """Every (tree, leaf, node, steps): the nodes on each path from a leaf up to its root, with their distance to the leaf."""
    ids = messages.select("tree", "node", "parent")
    ids = checkpointed(ids)
    inner = ids.select("tree", F.col("parent").alias("node")).where("node is not null").distinct()
    same = lambda a, b: a["tree"].eqNullSafe(b["tree"]) & (a["node"] == b["node"])
    leaves = ids.alias("a").join(inner.alias("b"), F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.node") == F.col("b.node")), "left_anti")
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("steps"))
    hops, step = ids.where("parent is not null").select("tree", "node", F.col("parent").alias("to")), 1
    most = ids.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while step <= most and hops.limit(1).count():
        h, p = hops.alias("h"), paths.alias("p")
        more = p.join(h, F.col("p.tree").eqNullSafe(F.col("h.tree")) & (F.col("p.node") == F.col("h.node"))).select(F.col("p.tree").alias("tree"), F.col("p.leaf").alias("leaf"), F.col("h.to").alias("node"), (F.col("p.steps") + step).alias("steps"))
        paths = checkpointed(paths.unionByName(more))
        a, b = hops.alias("a"), hops.alias("b")
        hops = checkpointed(a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.to") == F.col("b.node"))).select(F.col("a.tree").alias("tree"), F.col("a.node").alias("node"), F.col("b.to").alias("to")))
        step *= 2
    if step > most and hops.limit(1).count():  # who can go up further than its tree has messages is led into a cycle
        p, lost = paths.alias("p"), hops.select("tree", "node").distinct().alias("h")
        paths = p.join(lost, F.col("p.tree").eqNullSafe(F.col("h.tree")) & (F.col("p.leaf") == F.col("h.node")), "left_anti")
    return paths


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The best ``branches`` of each tree, as (tree, branch, node, place): branch from 1, place from the root."""
    paths = branch_paths(messages)
    scores = messages.select("tree", "node", "score")
    p, s = paths.alias("p"), scores.alias("s")
    scored = p.join(s, F.col("p.tree").eqNullSafe(F.col("s.tree")) & (F.col("p.node") == F.col("s.node"))).select("p.*", "s.score")
    leaves = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("mean"), F.count("*").alias("length"))
    ranked = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), F.desc("length"), "leaf"))).where(F.col("branch") <= branches)
    r = ranked.alias("r")
    return p.join(r, F.col("p.tree").eqNullSafe(F.col("r.tree")) & (F.col("p.leaf") == F.col("r.leaf"))).select("p.tree", "r.branch", "p.node", (F.col("r.length") - F.col("p.steps")).alias("place"))


def formatted(messages: DataFrame, branches: int = 1, learn: str = "assistant") -> DataFrame:
    """(tree, branch, formatted, loss_mask array<struct<start,end>>): one conversation per chosen path."""
    c, m = chosen_paths(messages, branches).alias("c"), messages.alias("m")
    turns = c.join(m, F.col("c.tree").eqNullSafe(F.col("m.tree")) & (F.col("c.node") == F.col("m.node"))).select("c.tree", "c.branch", "c.place", _role_out(F.col("m.role")).alias("role"), _escaped(F.col("m.text")).alias("text"), (F.col("m.role") == learn).alias("learn"))
    grouped = turns.groupBy("tree", "branch").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text", "learn"))).alias("turns"))
    body = F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n")))
    fixed = len(START) + len(END) + 2

    def add(acc, t):
        start = acc["at"] + len(START) + 1 + F.length(t["role"])
        end = start + F.length(t["text"])
        spans = F.when(t["learn"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct((acc["at"] + fixed + F.length(t["role"]) + F.length(t["text"])).alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    mask = F.aggregate("turns", zero, add, lambda acc: acc["spans"])
    return grouped.select("tree", "branch", F.array_join(body, "").alias("formatted"), mask.alias("loss_mask"))


def read_back(text: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role,text>>, unescaped."""
    parts = F.filter(F.split(text, "<\\|im_start\\|>"), lambda x: x != "")

    def turn(x):
        role = F.substring_index(x, "\n", 1)
        body = F.substring(x, F.length(role) + 2, F.length(x) - F.length(role) - 1 - len(END + "\n"))
        return F.struct(_role_in(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(parts, turn)
