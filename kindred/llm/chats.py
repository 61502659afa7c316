"""Chat formatting of reply trees, in DataFrame functions only.

Messages are nodes of trees. Self-joins of doubling reach give each node its root, depth and summed score; a conversation's leaves are
ranked by mean score, and the chosen leaves' ancestors are found by the same joins downwards. Each chosen path is one formatted
conversation: for each turn <|im_start|>role, a line break, the text, <|im_end|> and a line break. In roles and texts & < [ and in roles
line breaks are written as entities, so that no control string of this or the usual other templates is left in them, and reading
back restores each text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import written

START, END = "<|im_start|>", "<|im_end|>\n"
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
LINE = ("\n", "&#10;")


def escaped(text: Column, line: bool = False) -> Column:
    for raw, safe in (*ENTITIES, *((LINE,) if line else ())):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescaped(text: Column, line: bool = False) -> Column:
    for raw, safe in reversed((*ENTITIES, *((LINE,) if line else ()))):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escaped(role, True), F.lit("\n"), escaped(text), F.lit(END))


def paths(nodes: DataFrame, top: int = 1, max_rounds: int = 40) -> DataFrame:
    """tree, leaf, node, depth, rank: the nodes of the `top` best leaves' paths of each tree.

    nodes has tree, node (unique), parent (null: a root), score. A path's score is the mean over its nodes; ties go to the smaller leaf.
    Depth is 0 at the root. A parent that is absent makes a root. Rounds are the logarithm of the greatest depth.
    """
    known = nodes.select(F.col("node").alias("parent"))
    # reach k: up is the ancestor 2 ** k steps up, or null; sum and steps cover the nodes from here to just below it
    own = nodes.join(known, "parent", "left_semi").select("tree", "node", F.col("parent").alias("up"), "score")
    roots = nodes.join(own.select("node"), "node", "left_anti").select("tree", "node", F.lit(None).cast(dict(nodes.dtypes)["node"]).alias("up"), "score")
    state = written(own.unionByName(roots).select("tree", "node", "up", F.coalesce("score", F.lit(0.0)).cast("double").alias("sum"), F.lit(1).alias("steps")), "tree")
    reach = [state]
    while not state.where("up is not null").isEmpty():
        if len(reach) > max_rounds:
            raise ValueError("the replies form a ring")
        above = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("steps").alias("steps2"))
        far = state.where("up is not null").join(above, "up").select("tree", "node", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("steps") + F.col("steps2")).alias("steps"))
        state = written(far.unionByName(state.where("up is null")), "tree")
        reach.append(state)
    leaves = state.join(reach[0].where("up is not null").select(F.col("up").alias("node")), "node", "left_anti")
    best = W.partitionBy("tree").orderBy(F.desc(F.col("sum") / F.col("steps")), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    on = chosen.select("tree", F.col("node").alias("leaf"), "node", "rank")
    for step in reversed(reach[:-1]):
        higher = on.join(step.where("up is not null").select("node", "up"), "node").select("tree", "leaf", F.col("up").alias("node"), "rank")
        on = written(on.unionByName(higher), "paths")
    return on.join(state.select("node", (F.col("steps") - 1).alias("depth")), "node").select("tree", "leaf", "node", "depth", "rank")


def formatted_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """tree, rank, formatted, loss_spans: each chosen path as one text, with the (start, length) of the assistant's texts in code points.

    nodes has tree, node, parent, score, role, text. Null roles and texts are empty.
    """
    nodes = written(nodes, "messages")
    way = paths(nodes, top)
    said = way.join(nodes.select("node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), "node")
    turn = said.select("tree", "rank", F.struct("depth", (F.col("role") == "assistant").alias("learn"), turn_text(F.col("role"), F.col("text")).alias("t"), F.length(escaped(F.col("role"), True)).alias("r"), F.length(escaped(F.col("text"))).alias("n")).alias("x"))
    one = turn.groupBy("tree", "rank").agg(F.array_sort(F.collect_list("x")).alias("x"))
    lead = len(START) + 1

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + lead + x["r"]
        span = F.struct(start.alias("start"), x["n"].alias("length"))
        return F.struct((start + x["n"] + len(END)).alias("at"), F.when(x["learn"], F.array_append(state["s"], span)).otherwise(state["s"]).alias("s"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("s"))
    return one.select("tree", "rank", F.array_join(F.transform("x", lambda x: x["t"]), "").alias("formatted"), F.aggregate("x", first, add)["s"].alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    turns = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda t: t != "")
    body = lambda t: F.substring(t, F.lit(len(START) + 1), F.length(t))
    role = lambda t: F.substring_index(body(t), "\n", 1)
    return F.transform(turns, lambda t: F.struct(unescaped(role(t), True).alias("role"), unescaped(F.substring(body(t), F.length(role(t)) + 2, F.length(t))).alias("text")))


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Each row of conversations(conv_id, turn, role, text) as a reply to the row before it in its conversation.

    Rows go by turn (null first), ties by role and text. Rows with a null conv_id are one conversation.
    """
    rows = written(conversations.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("node")), "messages")
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text", "node")
    return rows.select(F.col("conv_id").alias("tree"), "node", F.lag("node").over(order).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def chat_digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted_paths(): conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = read_back(F.col("formatted"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.select(
        F.col("tree").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
