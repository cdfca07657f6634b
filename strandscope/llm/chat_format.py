"""Chat formatting of reply trees, in DataFrame operations only.

A message names the message that it replies to. Root-to-leaf paths are
enumerated by iterative self-joins: pointer doubling gives each message its
ancestors at distances 1, 2, 4, ..., and the paths of all leaves are filled in
from the largest distance down, so a path of n messages takes 2 log n joins
and no row grows before the path is put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .workspace import Workspace

START, END = "<|im_start|>", "<|im_end|>"
_TURN = r"(?s)<\|im_start\|>((?:[^\\\n]|\\.)*+)\n(.*?)<\|im_end\|>\n"


def escape(text: Column) -> Column:
    """No ``<|`` is left, so no control string can be; a backslash marks the character after it."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_paths(messages: DataFrame, space: Workspace) -> DataFrame:
    """tree, leaf, node, distance (from the leaf, 0 at the leaf) of every root-to-leaf path.

    ``messages`` has tree, node, parent (null at a root). A parent that is not
    in the tree counts as none. Chains of replies that form a cycle have no
    root and no leaf of their own and are not part of any path.
    """
    links = messages.select("tree", "node", "parent")
    known = links.select("tree", F.col("node").alias("parent"))
    up = space.table(links.where("parent is not null").join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("up")), "up0")
    ladders = [up]
    nodes = messages.count()
    while not ladders[-1].isEmpty() and 2 ** len(ladders) <= nodes:
        a = ladders[-1]
        b = a.select("tree", F.col("node").alias("up"), F.col("up").alias("far"))
        ladders.append(space.table(a.join(b, ["tree", "up"]).select("tree", "node", F.col("far").alias("up")), f"up{len(ladders)}"))
    leaves = links.select("tree", "node").join(up.select("tree", F.col("up").alias("node")), ["tree", "node"], "left_anti")
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("distance"))
    for k in range(len(ladders) - 1, -1, -1):
        step = paths.join(ladders[k], ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("distance") + 2**k).alias("distance"))
        paths = space.table(paths.unionByName(step), f"paths{k}")
    return paths


def format_trees(messages: DataFrame, *, top: int = 1, mask_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """tree, leaf, rank, score, formatted, loss (array<struct<start,stop>>) of the ``top`` branches of each tree.

    ``messages`` has tree, node, parent, role, text and score. A branch's score
    is the sum of its messages' scores (null counts as 0); branches are ranked
    by score, ties by the smaller leaf. ``loss`` holds the code-point ranges of
    the escaped texts of ``mask_roles``. Null roles and texts are empty. Nodes
    are unique in a tree. Other columns are not read; no rows give no rows.
    """
    space = Workspace(messages.sparkSession)
    rows = space.table(messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "messages")
    paths = reply_paths(rows, space)
    branches = paths.join(rows.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
    ranked = branches.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf"))).where(F.col("rank") <= top)
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    turn = paths.join(ranked, ["tree", "leaf"]).join(rows.drop("score", "parent"), ["tree", "node"])
    turn = turn.select("tree", "leaf", "rank", "score", F.struct((-F.col("distance")).alias("at"), head.alias("head"), escape(F.col("text")).alias("body"), F.col("role").isin(*mask_roles).alias("masked")).alias("t"))
    whole = turn.groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.first("score").alias("score"), F.array_sort(F.collect_list("t")).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    lengths = F.transform("turns", lambda t: F.struct(F.length(t["head"]).alias("h"), F.length(t["body"]).alias("b"), t["masked"].alias("m")))
    shape = "array<struct<start:long,stop:long>>"

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + t["h"]
        stop = start + t["b"]
        return F.struct((stop + len(END) + 1).alias("at"), F.when(t["m"], F.concat(a["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"))).cast(shape))).otherwise(a["out"]).alias("out"))

    loss = F.aggregate(lengths, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(shape).alias("out")), step)["out"]
    return whole.select("tree", "leaf", "rank", "score", text.alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Add turns (array<struct<role,text>>) and loss_text, parsed and unescaped from ``formatted`` and ``loss``."""
    part = lambda g: F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(g))
    turns = F.transform(F.arrays_zip(part(1).alias("role"), part(2).alias("text")), lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))
    return formatted.withColumn("turns", turns).withColumn("loss_text", F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), ""))


def conversation_messages(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees in which each turn replies to the one before it.

    Turns are ordered by turn, then role and text, so ties have an order; a
    null turn comes first. Every message scores 0. The tree is a struct of conv_id,
    so rows without one form a conversation too.
    """
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    n = F.row_number().over(order)
    return rows.select(F.struct("conv_id").alias("tree"), n.alias("node"), F.when(n > 1, n - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
