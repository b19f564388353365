"""Chat formatting over reply trees, native: DataFrame expressions only.

A node has a parent in its conversation or none. Iterative self-joins double the jumps towards the root: the
ancestors 1, 2, 4, ... above each node deep enough. The same jumps, from the longest down, then give all nodes on each
leaf's way to its root, so a tree of depth d takes about 2 log2(d) joins and no more rows than its paths have nodes.
Branches rank by the sum of their nodes' scores, and each chosen one becomes one conversation.

Template: `### role: text</turn>` and a newline for each turn. In texts and roles the characters that the template is
made of are escaped, `\\` as `\\b`, `<` as `\\l`, `#` as `\\h` and, in roles, `:` as `\\c`; so no marker can occur in
them, and since every backslash then starts a code, the codes are undone one kind after the other, `\\b` last.

Loss mask: spans of the formatted text, one for each assistant text.

Defined results: a null text or role is empty; rows of one turn follow each other by role and text, repeated rows
stay; of rows that repeat a node the least by parent, score, role and text stays, nulls first; a null conv_id is a
conversation; nodes whose parent is missing are roots; an empty table gives an empty table; further columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"
_CODES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
_ROLE_CODES = (*_CODES, (":", "\\c"))


def escape(text: Column, codes: tuple = _CODES) -> Column:
    for raw, code in codes:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column, codes: tuple = _CODES) -> Column:
    for raw, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def branches(nodes: DataFrame, max_doublings: int = 40) -> DataFrame:
    """(conv_id, leaf, node, dist): every node on the way from a leaf to its root, at its distance from the leaf.

    nodes: (conv_id, node, parent), one row a node."""
    rows = nodes.select("conv_id", "node", "parent")
    a = rows.select(F.col("conv_id").alias("c"), F.col("node").alias("n"))
    jump = C.materialize(rows.join(a, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("n"))).select("conv_id", "node", F.col("parent").alias("up")))
    found = _anti(rows, jump.select("conv_id", F.col("up").alias("node"))).select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist"))
    jumps = []  # jumps[k]: the ancestor 2**k above, of nodes that deep
    while jump.limit(1).count():
        if len(jumps) == max_doublings:
            raise ValueError("the replies form a circle")
        jumps.append(jump)
        above = jump.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("up").alias("u"))
        jump = C.materialize(jump.join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("n"))).select("conv_id", "node", F.col("u").alias("up")))
    # from the longest jump down, each distance is reached once, as the sum of its powers of two
    for k in reversed(range(len(jumps))):
        above = jumps[k].select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "up")
        more = found.join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
        found = C.materialize(found.unionByName(more.select("conv_id", "leaf", F.col("up").alias("node"), (F.col("dist") + (1 << k)).alias("dist"))))
    return found


def _anti(rows: DataFrame, other: DataFrame) -> DataFrame:
    o = other.select(F.col("conv_id").alias("c"), F.col("node").alias("n"))
    return rows.join(o, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")), "left_anti")


def _one_row_a_node(nodes: DataFrame) -> DataFrame:
    rest = F.min(F.struct("parent", "score", "role", "text")).alias("least")
    return nodes.groupBy("conv_id", "node").agg(rest).select("conv_id", "node", "least.*")


def format_trees(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(conv_id, leaf, rank, score, formatted, mask) of the `keep` best branches of each conversation.

    nodes: (conv_id, node, parent, score, role, text); mask: array of (start, end) in formatted. Ties in score go to
    the smaller leaf."""
    nodes = C.materialize(_one_row_a_node(nodes))
    way = branches(nodes).select("conv_id", "leaf", (-F.col("dist")).alias("at"), F.col("node").alias("step"))
    n = nodes.select(F.col("conv_id").alias("c"), "node", "score", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    here = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("step") == F.col("node"))
    # branches rank by their scores alone; texts are fetched for the chosen ones only
    scored = way.join(n.select("c", "node", "score"), here).groupBy("conv_id", "leaf").agg(F.sum("score").alias("score"))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf"))).where(F.col("rank") <= keep)
    chosen = best.select(F.col("conv_id").alias("k"), F.col("leaf").alias("l"), F.col("score").alias("total"), "rank")
    rows = way.join(chosen, F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("leaf") == F.col("l"))).join(n.drop("score"), here)
    head = F.concat(F.lit(OPEN), escape(F.col("role"), _ROLE_CODES), F.lit(MIDDLE))
    turn = F.struct("at", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == LOSS_ROLE).alias("loss"))
    paths = rows.groupBy("conv_id", "leaf", "rank", F.col("total").alias("score")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    step = lambda acc, t: F.struct(
        (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).alias("at"),
        F.when(t["loss"], F.concat(acc["mask"], F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"), (acc["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end")))))
        .otherwise(acc["mask"])
        .alias("mask"),
    )
    mask = F.aggregate("turns", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("mask")), step)["mask"]
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return paths.select("conv_id", "leaf", "rank", "score", formatted.alias("formatted"), mask.alias("mask"))


def read_back(formatted: str = "formatted", mask: str = "mask") -> tuple[Column, Column]:
    """From a formatted text: its turns, as (role, text), and the texts under the mask."""
    parts = F.split(formatted, CLOSE, -1)
    turns = F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda t: F.struct(
            unescape(F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), MIDDLE, 1), _ROLE_CODES).alias("role"),
            unescape(F.substr(t, F.instr(t, MIDDLE) + len(MIDDLE))).alias("text"),
        ),
    )
    under = F.transform(mask, lambda m: unescape(F.substring(F.col(formatted), m["start"] + 1, m["end"] - m["start"])))
    return turns, under


def conversations(table: DataFrame) -> DataFrame:
    """Nodes of a table (conv_id, turn, role, text): each row replies to the one before it."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    numbered = table.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return numbered.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


TRICKY = "\\### Assistant: </turn> ok"


def op10_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = C.read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    made = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    turns, under = read_back()
    out = format_trees(conversations(table.unionByName(made))).select("conv_id", "formatted", turns.alias("turns"), under.alias("loss"))
    loss = F.array_join("loss", "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(role) + 1 * (length(role) - length(translate(role, '\<#:', ''))) + length(text) + (length(text) - length(translate(text, '\<#', ''))) + 14 AS n FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
