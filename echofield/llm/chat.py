"""Reply trees turned into training conversations.

Messages point at the message they answer.  Self-joins that double their reach
carry every message to its root with the summed score of its path; the leaves
of a tree are ranked by that sum, and the chosen root-to-leaf paths are listed
by the same doubled pointers.  A path becomes one conversation in a chat
template whose turns can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofield.llm.common import shared_table

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """``text`` without control strings: one backslash more in every ``<|``, ``<\\|``, ``<\\\\|`` and so on."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """The same for a role, which must also stay on one line.

    A line end becomes backslash and n; backslashes right before an n or a line end are doubled.
    """
    return F.replace(F.regexp_replace(escape(role), r"(\\+)([n\n])", "$1$1$2"), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    lines = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescape(F.regexp_replace(lines, r"(?<!\\)(\\+)\1([n\n])", "$1$2"))


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, depth, id): the messages of the best ``branches`` paths of every tree, root at depth 0.

    ``messages`` has a unique ``id``, ``parent`` (null, or absent from the table,
    for a root) and ``score`` (null counts as 0).  Paths rank by their summed
    score, then by their length, then by the leaf's id.  Messages on a cycle
    belong to no tree.  Each pass is one self-join and doubles the reach.
    """
    given = messages.select("id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = given.select(F.col("id").alias("parent"), F.col("id").alias("up"))
    reached = shared_table(
        given.join(known, "parent", "left").select("id", "up", F.col("score").alias("sum"), F.lit(1).alias("steps"),
                                                   F.col("id").alias("top")),
        "replies",
    )
    at_root, climbing = reached.filter(F.col("up").isNull()), reached.filter(F.col("up").isNotNull())
    jumps = [climbing.select("id", "up")]
    limit = max(1, reached.count()).bit_length() + 1
    while len(jumps) <= limit and not climbing.isEmpty():
        # Only messages that have not reached their root yet are joined again.
        far = at_root.union(climbing).select(
            F.col("id").alias("up"), F.col("up").alias("_up"), F.col("sum").alias("_sum"),
            F.col("steps").alias("_steps"), F.col("top").alias("_top"),
        )
        reached = shared_table(
            climbing.join(far, "up").select(
                "id", F.col("_up").alias("up"), (F.col("sum") + F.col("_sum")).alias("sum"),
                (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_top").alias("top"),
            ),
            "replies",
        )
        at_root = at_root.union(reached.filter(F.col("up").isNull()))
        climbing = reached.filter(F.col("up").isNotNull())
        jumps.append(climbing.select("id", "up"))
    answered = given.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("id")).distinct()
    leaves = at_root.join(answered, "id", "left_anti")
    order = Window.partitionBy("top").orderBy(F.desc("sum"), F.desc("steps"), "id")
    best = leaves.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= branches)
    listed = shared_table(best.select(F.col("top").alias("tree"), F.col("id").alias("leaf"), "id",
                                      (F.col("steps") - 1).alias("depth")), "paths")
    for i, jump in enumerate(jumps[:-1]):
        further = listed.join(jump, "id").select("tree", "leaf", F.col("up").alias("id"),
                                                 (F.col("depth") - F.lit(1 << i)).alias("depth"))
        listed = shared_table(listed.union(further), "paths")
    return listed.select("tree", "leaf", "depth", "id")


def formatted(messages: DataFrame, branches: int = 1, trained: str = TRAINED_ROLE) -> DataFrame:
    """(tree, leaf, n_turns, formatted, loss): each chosen path as one conversation.

    ``messages`` also has ``role`` and ``text``; null counts as empty.  ``loss``
    lists the half-open spans of ``formatted``, in code points, that hold the
    texts of the ``trained`` role and nothing else.
    """
    texts = messages.select("id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths(messages, branches).join(texts, "id").select(
        "tree", "leaf", "depth", "role", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("lead"),
        escape(F.col("text")).alias("body"), F.lit(f"{END}\n").alias("close"),
    )
    size = F.char_length("lead") + F.char_length("body") + F.char_length("close")
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.char_length("lead")
    placed = turns.withColumn("begin", begin.cast("long"))
    span = F.struct(F.col("begin").alias("start"), (F.col("begin") + F.char_length("body")).alias("end"))
    rows = F.array_sort(F.collect_list(F.struct(
        "depth", F.concat("lead", "body", "close").alias("turn"), F.when(F.col("role") == trained, span).alias("span")
    )))
    return placed.groupBy("tree", "leaf").agg(rows.alias("rows")).select(
        "tree", "leaf", F.size("rows").cast("long").alias("n_turns"),
        F.array_join("rows.turn", "").alias("formatted"),
        F.filter("rows.span", lambda s: s.isNotNull()).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation, unescaped."""
    def turn(t: Column) -> Column:
        lead = F.substring_index(t, "\n", 1)
        role = F.substr(lead, F.lit(len(START) + 1))
        text = F.substr(t, F.char_length(lead) + 2)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def under_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))),
        "",
    )


def linear(conversations: DataFrame) -> DataFrame:
    """Conversations as reply trees: each row answers the one before it by turn.

    Rows of one turn are ordered by role and text.  Ids are conversation and
    place; a null conversation is a conversation of its own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    placed = conversations.select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(order))
    return placed.select(
        "conv_id", F.concat_ws(":", name, "place").alias("id"),
        F.when(F.col("place") > 1, F.concat_ws(":", name, F.col("place") - 1)).alias("parent"),
        "role", "text", F.lit(1.0).alias("score"),
    )
