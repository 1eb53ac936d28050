"""Chat formatting of reply trees.

Input: one row per message (tree, node, parent, score, role, text).  A parent
that is null or not in the tree makes a root.

1. Self-joins of the parent pointers, doubled each round, give every message
   its ancestors 1, 2, 4, ... levels up and the score of the path to them:
   ``log2(depth)`` joins instead of one per level.
2. Leaves are ranked within their tree by the score of their whole path (then
   by depth and node id); the best ``paths`` are chosen.
3. The jump tables, largest jump first, expand each chosen leaf into the
   messages of its path, and each path is formatted as one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per message.  Inside texts
and roles ``<|`` gets a backslash (``<\\|``; one more where some are there
already), line breaks of roles become ``\\n``; :func:`parse` undoes both.

Defined cases: null text or role is empty; messages on a parent cycle lie on no
root-to-leaf path and yield nothing; node ids must be
unique within a tree (callers number repeated rows first, as
:func:`conversation_nodes` does); null tree ids are one tree; an empty table
gives an empty result; other columns are ignored.  A conversation is one
result row, so its messages must fit one task (20,000 turns are tested).

Scale: every round is an equality join on (tree, node); nothing is collected
but one conversation's own messages, which are its result row.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, saved

START, END = "<|im_start|>", "<|im_end|>"


def escaped(c: Column) -> Column:
    """``<|`` with any backslashes between gets one more backslash."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(c: Column) -> Column:
    return escaped(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unrole(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text), flags=re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.removesuffix(END + "\n").partition("\n")
        turns.append((_unrole(role), unescape(text)))
    return turns


def loss_spans(formatted: str, role: str = "assistant") -> list[tuple[int, int]]:
    """Where the texts of one role stand in the formatted conversation."""
    spans, at = [], 0
    for part in formatted.split(START)[1:]:
        at += len(START)
        head = part.index("\n") + 1
        if _unrole(part[:head - 1]) == role:
            spans.append((at + head, at + len(part) - len(END) - 1))
        at += len(part)
    return spans


def jump_tables(nodes: DataFrame) -> list[DataFrame]:
    """``k``-th table: (tree, node, up, gain) with the ancestor 2**k levels up,
    ``gain`` the score of the messages passed (the node itself included)."""
    n = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    link = nodes.join(n, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left_semi")
    level = saved(link.select("tree", "node", F.col("parent").alias("up"), F.col("score").alias("gain")))
    most = nodes.count()
    tables: list[DataFrame] = []
    while not level.isEmpty():
        tables.append(level)
        if 2 ** (len(tables) - 1) > most:  # longer than any path: what is left runs in circles
            break
        hop = level.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("gain").alias("g2"))
        level = saved(level.join(hop, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n")))
                      .select("tree", "node", F.col("up2").alias("up"), (F.col("gain") + F.col("g2")).alias("gain")))
    return tables


def leaf_scores(nodes: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(tree, leaf, at, total, depth): each leaf walked up to its root."""
    child = nodes.select(F.col("tree").alias("t"), F.col("parent").alias("p"))
    at = nodes.join(child, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti").select(
        "tree", F.col("node").alias("leaf"), F.col("node").alias("at"), F.lit(0.0).alias("total"), F.lit(0).alias("depth"))
    for k, table in reversed(list(enumerate(tables))):
        up = table.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up", "gain")
        at = at.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("at") == F.col("n")), "left").select(
            "tree", "leaf", F.coalesce("up", "at").alias("at"), (F.col("total") + F.coalesce("gain", F.lit(0.0))).alias("total"),
            (F.col("depth") + F.when(F.col("up").isNull(), 0).otherwise(2 ** k)).alias("depth"))
    root = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("score").alias("own"))
    if tables:  # whoever still has a parent after all jumps runs in a circle
        linked = tables[0].select(F.col("tree").alias("lt"), F.col("node").alias("ln"))
        root = root.join(linked, F.col("t").eqNullSafe(F.col("lt")) & (F.col("n") == F.col("ln")), "left_anti")
    return at.join(root, F.col("tree").eqNullSafe(F.col("t")) & (F.col("at") == F.col("n"))).select(
        "tree", "leaf", "at", (F.col("total") + F.col("own")).alias("total"), "depth")


def format_paths(nodes: DataFrame, paths: int = 1) -> DataFrame:
    """(tree, leaf, total, n_turns, formatted): the best ``paths`` root-to-leaf
    paths of every tree, each as one formatted conversation."""
    nodes = saved(nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
                               F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    tables = jump_tables(nodes.drop("role", "text"))
    best = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "leaf")
    chosen = leaf_scores(nodes.drop("role", "text"), tables).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= paths)
    path = saved(chosen.select("tree", "leaf", "total", F.col("leaf").alias("at"), F.lit(0).alias("up_by")))
    for k, table in reversed(list(enumerate(tables))):
        up = table.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        further = path.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("at") == F.col("n"))).select(
            "tree", "leaf", "total", F.col("up").alias("at"), (F.col("up_by") + 2 ** k).alias("up_by"))
        path = saved(path.unionAll(further))
    said = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"),
                        F.concat(F.lit(START), _role(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit(END + "\n")).alias("said"))
    turns = path.join(said, F.col("tree").eqNullSafe(F.col("t")) & (F.col("at") == F.col("n")))
    return turns.groupBy("tree", "leaf", "total").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("up_by")).alias("o"), "said"))).alias("turns")).select(
        "tree", "leaf", "total", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.said", "").alias("formatted"))


def conversation_nodes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """A linear conversation table as a forest of one-branch trees: rows by turn
    (then role and text), each the reply to the row before."""
    order = Window.partitionBy(conv_col).orderBy(turn_col, "role", "text")
    node = F.row_number().over(order).cast("long")
    return messages.select(F.col(conv_col).alias("tree"), node.alias("node"), F.lit(1.0).alias("score"), "role", "text").withColumn(
        "parent", F.when(F.col("node") > 1, F.col("node") - 1))


def _digest(cols: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
    for conv, formatted in zip(cols["tree"], cols["formatted"]):
        turns = parse(formatted)
        learned = "".join(unescape(formatted[a:b]) for a, b in loss_spans(formatted))
        out["conv_id"].append(conv)
        out["n_turns"].append(len(turns))
        out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
        out["loss_chars"].append(len(learned))
        out["loss_sha256"].append(hashlib.sha256(learned.encode()).hexdigest())
        out["formatted_chars"].append(len(formatted))
    return out


def chat_digests(messages: DataFrame) -> DataFrame:
    """Every conversation formatted and read back: counts and digests."""
    done = format_paths(conversation_nodes(messages)).select("tree", "formatted")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return map_rows(done, _digest, schema)
