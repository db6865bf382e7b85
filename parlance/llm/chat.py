"""Reply trees to training conversations, in DataFrame operations only.

A forest is a table of messages, each with its parent.  Paths from the root are
found by iterative self-joins that double their reach: after step ``k`` every
message points ``2**k`` ancestors up and holds the score summed on the way, so a
thread of a thousand replies takes ten joins.  Leaves are ranked within their
tree by that sum; the best ``branches`` of them are walked back with the same
pointers, and each chosen path is formatted as one conversation.

Template: ``<|im_start|>role`` newline text ``<|im_end|>`` newline.  In roles and
texts a backslash is doubled and ``<|`` becomes ``<\\|``, in roles a newline
becomes ``<\\n``; a single backslash thus only stands after ``<``, ``<|`` in the
output is always the template's, and the escape can be undone.  ``loss_mask`` lists the code points (start, end exclusive)
of each assistant text.

Null text or role: empty.  Null or equal turns: ordered by turn (nulls first),
then role, then text; repeated rows are repeated turns.  Null conv_id: its own
conversation.  An empty table gives no rows.  Other columns are left out.

Forests: a message whose parent isn't there is a root.  Of several messages of one
number in a tree, the one that sorts first by parent (null first), role and text
counts; messages without a number are left out.  Messages in a circle, and those
that hang from one, reach no root and are on no path; after as many doublings as
the largest tree could need, what still has an ancestor to reach is one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.runtime import cut

BEGIN, END = "<|im_start|>", "<|im_end|>"


def escape(c: Column, in_role: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(c, F.lit("\n"), F.lit("<\\n")) if in_role else c


def unescape(c: Column, in_role: bool = False) -> Column:
    c = F.replace(c, F.lit("<\\n"), F.lit("\n")) if in_role else c
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def chain_of(turns: DataFrame) -> DataFrame:
    """A table of turns as a forest: each turn answers the one before it."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return turns.select("conv_id", F.row_number().over(w).cast("long").alias("node"), "role", "text").withColumn(
        "parent", F.when(F.col("node") > 1, F.col("node") - 1)
    )


def best_paths(forest: DataFrame, branches: int = 1, score: Column | None = None, numbered: bool = False) -> DataFrame:
    """Rows (conv_id, branch, depth, role, text) of each tree's best paths.

    ``forest`` has conv_id (the tree), node, parent (null for a root), role and
    text; ``score`` is summed over a path, by default the message's length.
    Ties go to the smaller leaf.  ``numbered`` says that no number comes twice in a tree.
    """
    score = F.length("text").cast("double") if score is None else score
    nodes = forest.select("conv_id", "node", "parent", "role", "text", F.coalesce(score, F.lit(0.0)).cast("double").alias("score"))
    if not numbered:
        one = F.min(F.struct("parent", "role", "text", "score")).alias("m")
        nodes = nodes.where("node is not null").groupBy("conv_id", "node").agg(one).select("conv_id", "node", "m.*")
    nodes = cut(nodes)
    largest = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    reach = nodes.select("conv_id", "node", F.col("parent").alias("up"), "score", F.lit(1).cast("long").alias("depth"))
    steps = []
    for _ in range(largest.bit_length() + 1):
        # only messages that haven't reached their root take part in a step
        going = reach.where("up is not null")
        if going.isEmpty():
            break
        steps.append(going.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "up"))
        above = reach.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("depth").alias("depth2"))
        moved = going.join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("n")), "left").select(
            "conv_id", "node", F.col("up2").alias("up"), (F.col("score") + F.coalesce("score2", F.lit(0.0))).alias("score"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth")
        )
        reach = cut(moved.union(reach.where("up is null")))
    reach = reach.where("up is null")
    parents = nodes.where("parent is not null").select(F.col("conv_id").alias("c"), F.col("parent").alias("p")).distinct()
    leaves = reach.join(parents, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("p")), "left_anti")
    rank = Window.partitionBy("conv_id").orderBy(F.col("score").desc(), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= branches)
    marked = cut(chosen.select("conv_id", "branch", "node"))
    for step in steps:
        higher = marked.join(step, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).select("conv_id", "branch", F.col("up").alias("node"))
        marked = cut(marked.union(higher))
    message = nodes.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "role", "text")
    place = reach.select(F.col("conv_id").alias("c2"), F.col("node").alias("n2"), "depth")
    return (
        marked.join(message, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
        .join(place, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("node") == F.col("n2")))
        .select("conv_id", "branch", "depth", "role", "text")
    )


def format_paths(paths: DataFrame) -> DataFrame:
    """One row (conv_id, branch, formatted, loss_mask) for each path."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    pieces = paths.select("conv_id", "branch", F.struct("depth", (role == "assistant").alias("loss"), escape(role, True).alias("role"), escape(text).alias("text")).alias("t"))
    whole = pieces.groupBy("conv_id", "branch").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    rendered = lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit("\n"), t["text"], F.lit(f"{END}\n"))
    mask = F.aggregate(
        "ts",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask")),
        lambda s, t: F.struct(
            (s["at"] + F.length(rendered(t))).alias("at"),
            F.when(
                t["loss"],
                F.array_append(
                    s["mask"],
                    F.struct(
                        (s["at"] + len(BEGIN) + F.length(t["role"]) + 1).alias("start"),
                        (s["at"] + len(BEGIN) + F.length(t["role"]) + 1 + F.length(t["text"])).alias("end"),
                    ),
                ),
            ).otherwise(s["mask"]).alias("mask"),
        ),
        lambda s: s["mask"],
    )
    return whole.select("conv_id", "branch", F.array_join(F.transform("ts", rendered), "").alias("formatted"), mask.alias("loss_mask"))


def format_conversations(turns: DataFrame, branches: int = 1) -> DataFrame:
    return format_paths(best_paths(chain_of(turns), branches, numbered=True))


def read_back(formatted: DataFrame) -> DataFrame:
    """The digests of each conversation, from the formatted text and mask alone."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda p: p != "")
    turn = lambda p: F.concat(
        unescape(F.substring_index(F.substr(p, F.lit(len(BEGIN) + 1)), "\n", 1), True),
        F.lit("\n"),
        unescape(F.substr(p, F.locate("\n", p) + 1)),
        F.lit("\n"),
    )
    masked = F.transform("loss_mask", lambda m: unescape(F.substr("formatted", (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    return formatted.withColumn("loss", F.array_join(masked, "")).select(
        "conv_id",
        F.size(pieces).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(pieces, turn), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
