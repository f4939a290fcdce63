"""Reply trees as formatted conversations.

Messages form trees: every message answers its parent. Pointer doubling (self
joins that double the distance at each round) finds each message's depth and
the score of its whole branch; in every tree the leaves are ranked by the
branch's mean score, then its length, then the leaf; and the chosen leaves'
paths are gathered by the same doubled pointers. Rounds are the logarithm of
the longest branch. Each path becomes one text:

    <|im_start|>role NEWLINE text<|im_end|> NEWLINE

In texts and roles a backslash is doubled and ``<|`` becomes ``<\\|``, so no
control string occurs inside a text; a role's line breaks become ``\\n``.
``loss_spans`` holds the code-point spans of the assistant's (escaped) texts.

Defined cases: null texts and roles count as empty; a missing parent makes a
root; a message on a cycle has no root and is left out; rows that repeat are
turns of their own, in the order (turn, role, text); rows of a null
conversation form one conversation; empty tables give no rows; other columns
are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinworks.llm.storage import checkpointed

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    """A role's pairs are undone from the left: every escape begins with a backslash, but for the pipe's."""
    parts = F.split(role, r"\\\\")  # at doubled backslashes
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|"))), "\\")


def turn_tree(rows: DataFrame) -> DataFrame:
    """Messages of tables that hold one row per turn: each answers the row before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_n", F.row_number().over(order).cast("long"))
    return numbered.select(F.col("conv_id").alias("tree"), F.col("_n").alias("message"), F.when(F.col("_n") > 1, F.col("_n") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def reply_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """The messages of the ``best`` branches of every tree: tree, rank, position, role, text.

    ``messages`` has tree, message, parent (null at a root), role, text and score; (tree, message) is a key.
    """
    rows = checkpointed(messages.select("tree", "message", "parent", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score")))
    same = lambda a, b: a.eqNullSafe(b)  # noqa: E731  a tree may be null
    known = rows.select(F.col("tree").alias("_t"), F.col("message").alias("_m"))
    links = rows.join(known, same(rows["tree"], known["_t"]) & (rows["parent"] == known["_m"]), "left").select("tree", "message", F.col("_m").alias("up"), "score", F.lit(1).cast("long").alias("depth"))
    longest = rows.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    hops = []
    state = checkpointed(links)
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        hops.append(state.select("tree", "message", "up").where("up is not null"))
        far = state.select(F.col("tree").alias("_t"), F.col("message").alias("_m"), F.col("up").alias("_up"), F.col("score").alias("_s"), F.col("depth").alias("_d"))
        on = same(state["tree"], far["_t"]) & (state["up"] == far["_m"])
        state = checkpointed(state.join(far, on, "left").select("tree", "message", F.col("_up").alias("up"), (F.col("score") + F.coalesce("_s", F.lit(0.0))).alias("score"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth")))
    rooted = state.where("up is null")
    parents = rows.where("parent is not null").select(F.col("tree").alias("_t"), F.col("parent").alias("_p")).distinct()
    leaves = rooted.join(parents, same(rooted["tree"], parents["_t"]) & (rooted["message"] == parents["_p"]), "left_anti")
    ranked = Window.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("depth")), F.desc("depth"), "message")
    on_path = leaves.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= best).select("tree", "rank", "message")
    for hop in hops:
        step = hop.select(F.col("tree").alias("_t"), F.col("message").alias("_m"), "up")
        up = on_path.join(step, same(on_path["tree"], step["_t"]) & (on_path["message"] == step["_m"])).select("tree", "rank", F.col("up").alias("message"))
        on_path = checkpointed(on_path.unionByName(up))  # else every round doubles the plan
    depth = rooted.select(F.col("tree").alias("_t"), F.col("message").alias("_m"), F.col("depth").alias("position"))
    texts = rows.select(F.col("tree").alias("_t2"), F.col("message").alias("_m2"), "role", "text")
    placed = on_path.join(depth, same(on_path["tree"], depth["_t"]) & (on_path["message"] == depth["_m"]))
    return placed.join(texts, same(placed["tree"], texts["_t2"]) & (placed["message"] == texts["_m2"])).select("tree", "rank", "position", "role", "text")


def formatted(paths: DataFrame) -> DataFrame:
    """One row per path: tree, rank, ``formatted`` and ``loss_spans`` (start and end in code points)."""
    role, text = escaped_role(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    turns = paths.select("tree", "rank", F.struct("position", "role", head.alias("head"), text.alias("body"), F.concat(head, text, F.lit(END + "\n")).alias("all")).alias("_turn"))
    listed = turns.groupBy("tree", "rank").agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    ends = F.aggregate("_turns", F.array(F.lit(0)), lambda s, t: F.concat(s, F.array(F.element_at(s, -1) + F.char_length(t["all"]))))
    spans = F.filter(
        F.transform("_turns", lambda t, i: F.when(t["role"] == "assistant", F.struct((F.get("_ends", i) + F.char_length(t["head"])).alias("start"), (F.get("_ends", i) + F.char_length(t["head"]) + F.char_length(t["body"])).alias("end")))),
        lambda s: s.isNotNull(),
    )
    text = F.array_join(F.transform("_turns", lambda t: t["all"]), "")
    return listed.withColumn("_ends", ends).select("tree", "rank", text.alias("formatted"), spans.alias("loss_spans"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted conversation, as structs of role and text."""
    parts = F.split(text, F.lit(r"<\|im_end\|>\n"))
    bare = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.substring(p, len(START) + 1, 2**31 - 1))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        return F.struct(unescaped_role(role).alias("role"), unescaped(p.substr(F.char_length(role) + 2, F.lit(2**31 - 1))).alias("text"))

    return F.transform(bare, turn)


def digests(chats: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: number and digest of turns, and length and digest of all text under the mask."""
    read = chats.withColumn("_read", read_turns(F.col("formatted"))).withColumn("_loss", F.array_join(F.transform("loss_spans", lambda s: unescaped(F.col("formatted").substr(s["start"] + 1, s["end"] - s["start"]))), ""))
    turns = F.array_join(F.transform("_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("_read").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
