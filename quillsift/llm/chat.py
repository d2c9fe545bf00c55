"""Chat formatting of reply trees, in DataFrame operations only.

Paths are enumerated by iterative self-joins: every message holds a pointer up the tree that doubles its reach each
round, so a thread of n messages takes log2(n) rounds. A leaf then knows its branch's score; branches are ranked, and the messages of
the chosen one are found by walking its leaf down the same pointers. Texts take no part in the rounds.

Template: <|im_start|>role LF text <|im_end|> LF. Inside a text or role, each < \\...\\ | gets one more backslash, which
reading takes away; a line feed or backslash of a role is written with a backslash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, sha256_hex

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def best_paths(tree: DataFrame, top: int = 1) -> DataFrame:
    """(conv, msg, leaf, branch, depth) of the messages on each conversation's `top` best root-to-leaf paths.

    `tree` has conv, msg, parent (null: a root; so is a message whose parent isn't there) and score. Branches rank by the sum of their scores, then depth, then the
    smaller leaf. Messages that lead round in a circle have no root and are on no path.
    """
    there = tree.select("conv", F.col("msg").alias("parent"), F.lit(True).alias("there"))
    state = settle(tree.join(there, ["conv", "parent"], "left").select("conv", "msg", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").cast("double").alias("total")))
    parents = state.where("up IS NOT NULL").select("conv", F.col("up").alias("msg")).distinct()
    leaves = state.join(parents, ["conv", "msg"], "left_anti").select("conv", "msg")
    reach, rounds = [], 1 + max(1, math.ceil(math.log2(max(2, state.count()))))
    while len(reach) < rounds and (pending := state.where("up IS NOT NULL")).head(1):
        reach.append(pending.select("conv", "msg", "up"))
        above = state.select("conv", F.col("msg").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        # only pointers that haven't reached a root are joined: a thread's rows leave the rounds as soon as its own depth is covered
        moved = pending.join(above, ["conv", "up"]).select(
            "conv", "msg", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total")
        )
        state = settle(moved.union(state.where("up IS NULL").select("conv", "msg", "up", "depth", "total")))
    ranked = state.where("up IS NULL").join(leaves, ["conv", "msg"])
    if top == 1:
        best = ranked.groupBy("conv").agg(F.max(F.struct("total", "depth", (-F.col("msg")).alias("m"))).alias("x")).select("conv", (-F.col("x.m")).alias("leaf"), F.lit(1).alias("branch"))
    else:
        order = Window.partitionBy("conv").orderBy(F.desc("total"), F.desc("depth"), "msg")
        best = ranked.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= top).select("conv", F.col("msg").alias("leaf"), "branch")
    path = best.select("conv", F.col("leaf").alias("msg"), "leaf", "branch")
    for step in reversed(reach):
        up = path.join(step, ["conv", "msg"]).select("conv", F.col("up").alias("msg"), "leaf", "branch")
        path = settle(path.union(up))
    return path.join(state.select("conv", "msg", "depth"), ["conv", "msg"])


def segments(role: Column, text: Column) -> Column:
    """A turn's pieces with the loss mask: on for what an assistant says, off for the template and everyone else."""
    piece = lambda p, loss: F.struct(p.alias("piece"), loss.alias("loss"))
    return F.array(piece(F.concat(F.lit(OPEN), escape_role(role), F.lit("\n")), F.lit(False)), piece(escape(text), role == "assistant"), piece(F.lit(CLOSE), F.lit(False)))


def format_conversations(messages: DataFrame, top: int = 1) -> DataFrame:
    """(conv_id, branch, segments, formatted): each chosen path as one conversation, with its loss mask by segment.

    `messages` has conv_id, turn, role, text and may have parent (a turn of the same conversation) and score; without
    parent each message answers the one before by turn, repeated rows and ties (by role, then text's hash) included. With parent, a turn of a
    conversation is one message: of several rows the one with the least parent (null first), role and text's hash counts, and what is left equal are copies. Null
    texts and roles are empty, a null conversation is one of its own, other columns are ignored, and an empty table gives none.
    """
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    if "parent" in messages.columns:
        tree = messages.select(
            "conv_id", conv.alias("conv"), F.col("turn").cast("long").alias("msg"), F.col("parent").cast("long").alias("parent"), role.alias("role"), text.alias("text"),
            (F.col("score").cast("double") if "score" in messages.columns else F.lit(None).cast("double")).alias("score"), F.xxhash64(text).alias("mark"),
        )
        first = Window.partitionBy("conv", "msg").orderBy("parent", "role", "mark", "score")
        rows = tree.where("msg IS NOT NULL").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth", "mark")
    else:
        order = Window.partitionBy("conv").orderBy("turn", "role", "mark")
        plain = messages.select("conv_id", conv.alias("conv"), "turn", role.alias("role"), text.alias("text"), F.xxhash64(text).alias("mark"))
        numbered = plain.withColumn("msg", F.row_number().over(order).cast("long"))
        rows = numbered.select("conv_id", "conv", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(None).cast("double").alias("score"))
    # numbered once; the rounds read its narrow columns only, and the texts come in at the end
    rows = settle(rows)
    path = best_paths(rows.select("conv", "msg", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), top)
    chosen = rows.drop("parent", "score").join(path, ["conv", "msg"])
    turns = chosen.groupBy("conv", "branch").agg(F.first("conv_id", ignorenulls=True).alias("conv_id"), F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    made = turns.select("conv_id", "branch", F.flatten(F.transform("turns", lambda t: segments(t["role"], t["text"]))).alias("segments"))
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["piece"]), ""))


def read_back(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    turn = r"(?s)^([^\n]*)\n(.*)<\|im_end\|>\n\z"
    parts = F.split(formatted, r"<\|im_start\|>", -1)
    return F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda p: F.struct(unescape_role(F.regexp_extract(p, turn, 1)).alias("role"), unescape(F.regexp_extract(p, turn, 2)).alias("text")))


def digest(made: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted text and the mask."""
    known = made.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["piece"])), ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return known.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha256_hex(said).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), sha256_hex(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
