"""Chat formatting of reply trees with DataFrame functions only (operator 8).

Messages form trees by (tree, node, parent). Each root-to-leaf path is a conversation:

1. **Jumps**: self-joins double the reach of each node's ancestor pointer (1, 2, 4, ... up) and
   the sum of scores on the way, until no pointer is left; the rounds are the logarithm of the
   depth, and each round's table is written to the shared folder.
2. **Rank**: a leaf's path score is its mean score from root to leaf; with ``top``, leaves of a tree
   are ranked by it (then longer paths, then the smaller node) and the best ``top`` stay, each task
   passing on no more than ``top`` leaves of a tree. Without it all leaves stay, unranked.
3. **Paths**: from the chosen leaves, one self-join per table of jumps adds to every member of a
   path the one 2^k above, so a path of n messages is listed after log2(n) joins. Only chosen
   paths are listed, so a wide tree never repeats its trunk for leaves that are not wanted.
4. **Format**: a path becomes one text in the template ``<|im_start|>role\\ntext<|im_end|>\\n``, and
   the loss mask the spans (code points) of its assistant texts.

Control strings inside texts are escaped so that the template's own markers are the only ones:
``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``; in roles also a line feed becomes ``\\n``. ``read_turns``
and ``read_loss`` undo it from the formatted text alone.

A conversation is one row of the result, so its messages meet in one task; that is the only thing
gathered, and a hot conversation is bounded by what a row can hold. Ancestor joins are on nodes.

Defined cases: a null text or role counts as empty, a null score as 0; a message whose parent is
not in its tree (or null) is a root; messages without tree or node are left out, as are repeated
(tree, node) rows but one (the smallest role and text); nodes on a cycle reach no root and are in no path.
Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, written

START, END = "<|im_start|>", "<|im_end|>"
#: Role whose texts carry the loss.
LOSS_ROLE = "assistant"
#: Doublings after which pointers still open can only be cycles (depth 2^40).
MOST_ROUNDS = 40


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Pairs of backslashes split the text; what is left of single ones stands before ``|``."""
    parts = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("<\\|"), F.lit("<|"))), "\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(
        F.replace(p, F.lit("<\\|"), F.lit("<|")), F.lit("\\n"), F.lit("\n"))), "\\")


def linear_parents(rows: DataFrame, *, tree: str, order: str, role: str = "role",
                   text: str = "text") -> DataFrame:
    """Conversations given as ordered turns, as trees: (tree, node, parent, role, text), each turn
    answering the one before. Equal turns are ordered by role and text."""
    w = Window.partitionBy(tree).orderBy(F.col(order), F.col(role), F.col(text))
    return rows.select(F.col(tree).alias("tree"), F.row_number().over(w).cast("long").alias("node"),
                       F.col(role).alias("role"), F.col(text).alias("text")) \
        .withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def reply_paths(messages: DataFrame, *, tree: str = "tree", node: str = "node", parent: str = "parent",
                role: str = "role", text: str = "text", score: str | None = None,
                top: int | None = None) -> DataFrame:
    """(tree, leaf, path_score, rank, depth, role, text) of every message on a chosen path, depth 0
    being the root; rank is null without ``top``."""
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    given = messages.select(
        F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), value.alias("score")) \
        .filter("tree is not null and node is not null")
    one = Window.partitionBy("tree", "node").orderBy("role", "text", "score", "parent")
    nodes = written(given.withColumn("k", F.row_number().over(one)).filter("k = 1").drop("k"), "messages")
    thin = nodes.select("tree", "node", "parent", "score")
    known = nodes.select("tree", F.col("node").alias("parent"))
    # a pointer: ``up`` is 2^k messages above ``node``; ``sum`` covers the 2^k messages from ``node`` on
    jump = written(thin.join(known, ["tree", "parent"], "left_semi")
                   .select("tree", "node", F.col("parent").alias("up"), F.col("score").alias("sum")), "jump")
    jumps: list[DataFrame] = []
    while not jump.isEmpty():
        if len(jumps) == MOST_ROUNDS:
            raise ValueError("reply_paths: parents form a cycle")
        jumps.append(jump)
        above = jump.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("sum").alias("sum2"))
        jump = Table(jump.join(above, ["tree", "up"])
                     .select("tree", "node", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum")),
                     "jump").df
    parents = thin.select("tree", F.col("parent").alias("node")).filter("node is not null")
    leaves = nodes.join(parents.distinct(), ["tree", "node"], "left_anti") \
        .select("tree", F.col("node").alias("leaf"), F.col("node").alias("at"),
                F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("above"))
    # climb with the longest jumps first: at the end ``at`` is the root
    for k in range(len(jumps) - 1, -1, -1):
        j = jumps[k].select("tree", F.col("node").alias("at"), "up", F.col("sum").alias("more"))
        leaves = leaves.join(j, ["tree", "at"], "left").select(
            "tree", "leaf", F.coalesce("up", "at").alias("at"),
            (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("sum"),
            (F.col("above") + F.when(F.col("up").isNotNull(), F.lit(1 << k)).otherwise(0)).alias("above"))
    roots = thin.select("tree", F.col("node").alias("at"), F.col("score").alias("own"))
    ranked = leaves.join(roots, ["tree", "at"]).select(
        "tree", "leaf", "above", ((F.col("sum") + F.col("own")) / (F.col("above") + 1)).alias("path_score"))
    if top is None:
        ranked = ranked.withColumn("rank", F.lit(None).cast("int"))
    else:
        best = Window.partitionBy("tree").orderBy(F.desc("path_score"), F.desc("above"), "leaf")
        ranked = ranked.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    ranked = written(ranked, "leaves")
    path = ranked.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("dist"))
    for k, j in enumerate(jumps):
        more = path.join(j.select("tree", "node", "up"), ["tree", "node"]).select(
            "tree", "leaf", F.col("up").alias("node"), (F.col("dist") + (1 << k)).alias("dist"))
        path = Table(path.unionByName(more), "path").df
    return (path.join(ranked, ["tree", "leaf"]).join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
            .select("tree", "leaf", "path_score", "rank", (F.col("above") - F.col("dist")).alias("depth"),
                    "role", "text"))


def format_paths(paths: DataFrame) -> DataFrame:
    """(tree, leaf, path_score, rank, n_turns, formatted, loss): one row per path; ``loss`` holds the
    spans (start, end in code points) of the assistant texts."""
    head = F.concat(F.lit(START), F.col("_role"), F.lit("\n"))
    turn = paths.withColumn("_role", escape_role(F.col("role"))).withColumn("_text", escape(F.col("text"))) \
        .select("tree", "leaf", "path_score", "rank", "depth",
                (F.col("role") == LOSS_ROLE).alias("learn"), F.length(head).cast("long").alias("lead"),
                F.length("_text").cast("long").alias("size"),
                F.concat(head, F.col("_text"), F.lit(END + "\n")).alias("turn"))
    so_far = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("turn")).over(so_far), F.lit(0)) + F.col("lead")
    placed = turn.withColumn("start", start)
    turns = F.sort_array(F.collect_list(F.struct("depth", "turn", "learn", "start", "size")))
    return (placed.groupBy("tree", "leaf", "path_score", "rank").agg(turns.alias("t"))
            .select("tree", "leaf", "path_score", "rank", F.size("t").cast("long").alias("n_turns"),
                    F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"),
                    F.transform(F.filter("t", lambda x: x["learn"]),
                                lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["size"]).alias("end")))
                    .alias("loss")))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted text."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, 1 << 30)
    tail = len(END) + 1

    def turn(p: Column) -> Column:
        cut = F.instr(p, "\n")
        role = F.substring(p, F.lit(1), cut - 1)
        text = F.substring(p, cut + 1, F.length(p) - cut - tail)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(loss, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
