"""Reply trees formatted as conversations.

A tree's rows are its messages: conversation, node, parent (null: a root), role, text and score. Every root-to-leaf
path is a branch; its score is the sum of its messages' scores. Branches are ranked in their conversation (ties: the
smaller leaf) and each chosen one is formatted as one conversation.

Paths are enumerated by self-joins. Runs of messages with one reply each are first collapsed to a segment by pointer
doubling, in as many joins as the logarithm of the longest run; then branches climb from their leaf's segment to the
root's, a segment at each join. Long conversations without branches take no climbing.

Template: a message is ``[INST]role\\ntext[/INST]``, that of the assistant ``<s>role\\ntext</s>``. Control strings
within texts and roles get a backslash after their bracket (and one more where they have some), which is undone when
read; roles also escape line ends. The loss covers the assistants' texts.

Null roles and texts are empty. Nulls in the conversation's key form one conversation. A parent that isn't there, or
null, makes a root. Of rows that repeat a message the least stays, and the smallest message of a circle of replies becomes
a root. Columns not named are ignored. An empty table gives no conversation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.scratch import written

_CONTROL = r"(</?|\[/?)(\\*)(s>|INST\])"
_ESCAPED = r"(</?|\[/?)\\(\\*)(s>|INST\])"
ASSISTANT = "assistant"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, _CONTROL, r"$1\\$2$3")


def escaped_role(c: Column) -> Column:
    return escaped(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def formatted(role: Column, text: Column) -> Column:
    """One message under the template; nulls are empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    body = F.concat(escaped_role(role), F.lit("\n"), escaped(text))
    return F.when(role == ASSISTANT, F.concat(F.lit("<s>"), body, F.lit("</s>"))).otherwise(F.concat(F.lit("[INST]"), body, F.lit("[/INST]")))


def read_back(conversation: str) -> list[tuple[str, str, int, int]]:
    """role, text, and where the text's form stands (code points, end exclusive; an empty run where no loss) of each message."""
    found, at = [], 0
    while at < len(conversation):
        opening, closing = ("<s>", "</s>") if conversation.startswith("<s>", at) else ("[INST]", "[/INST]")
        if not conversation.startswith(opening, at):
            raise ValueError(f"no message at {at}")
        end = conversation.index(closing, at)
        line = conversation.index("\n", at)
        role = re.sub(_ESCAPED, r"\1\2\3", conversation[at + len(opening) : line])
        role = re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", role)
        text = re.sub(_ESCAPED, r"\1\2\3", conversation[line + 1 : end])
        found.append((role, text, line + 1, end if opening == "<s>" else line + 1))
        at = end + len(closing)
    return found


def as_trees(nodes: DataFrame) -> DataFrame:
    """``nodes`` as trees: one row for a message, and no message among those above itself.

    Of rows that repeat a message the least (parent, role, text, score) stays. Of messages that reply to each other in a
    circle the smallest loses its parent. Rows without a node are left out. Where every parent is smaller than its reply
    there is no circle; only otherwise are parents followed, doubling the distance each round.
    """
    rest = [c for c in nodes.columns if c not in ("conv", "node")]
    first = ["parent", "role", "text", "score"]
    least = F.min(F.struct(*(F.col(c) for c in (*first, *(c for c in rest if c not in first)))))
    one = written(nodes.where(F.col("node").isNotNull()).groupBy("conv", "node").agg(least.alias("_row")).select("conv", "node", *(F.col(f"_row.{c}").alias(c) for c in rest)), "messages")
    if one.where(F.col("parent") >= F.col("node")).isEmpty():
        return one
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    further = lambda step: step.select(F.col("conv").alias("c"), F.col("node").alias("of"), F.col("to").alias("next"), F.col("least").alias("low"))
    ids = one.select(F.col("conv").alias("c"), F.col("node").alias("of"))
    # Where each message gets to by so many steps, and the least message on the way; those that get past a root are left out.
    step = written(one.where(F.col("parent").isNotNull()).join(ids, same("conv", "c") & (F.col("parent") == F.col("of"))).select("conv", "node", F.col("parent").alias("to"), F.least("node", "parent").alias("least")), "above")
    for _ in range(max(one.count(), 2).bit_length()):
        step = written(step.join(further(step), same("conv", "c") & (F.col("to") == F.col("of"))).select("conv", "node", F.col("next").alias("to"), F.least("least", "low").alias("least")), "above")
        if step.isEmpty():
            return one
    # After more steps than there are messages only circles are reached, and all of each.
    roots = written(step.where(F.col("node") == F.col("least")).join(step.select(F.col("conv").alias("c"), F.col("to").alias("of")).distinct(), same("conv", "c") & (F.col("node") == F.col("of")), "left_semi").select(F.col("conv").alias("c"), F.col("node").alias("of")), "circles")
    return one.join(roots, same("conv", "c") & (F.col("node") == F.col("of")), "left").select("conv", "node", F.when(F.col("of").isNull(), F.col("parent")).alias("parent"), *(c for c in rest if c != "parent"))


def segments(nodes: DataFrame) -> DataFrame:
    """nodes with head (first node of its run), place (steps from the head) and n_replies, written."""
    replies = nodes.where(F.col("parent").isNotNull()).groupBy("conv", F.col("parent").alias("of")).agg(F.count(F.lit(1)).alias("n_replies"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    counted = nodes.join(replies.withColumnRenamed("conv", "c"), same("conv", "c") & (F.col("node") == F.col("of")), "left").select(*nodes.columns, F.coalesce("n_replies", F.lit(0)).alias("n_replies"))
    counted = written(counted, "tree")
    up = counted.select(F.col("conv").alias("c"), F.col("node").alias("of"), F.col("n_replies").alias("siblings"))
    start = counted.join(up, same("conv", "c") & (F.col("parent") == F.col("of")), "left").select(
        *counted.columns,
        F.when(F.col("siblings").isNull(), F.lit(None)).otherwise(F.col("parent")).alias("above"),
        F.when(F.col("siblings") == 1, F.col("parent")).otherwise(F.col("node")).alias("head"),
        F.when(F.col("siblings") == 1, 1).otherwise(0).cast("long").alias("place"),
    )
    # Only messages whose head may still move join again; those that are settled stay as they are.
    settled, open_ = [], written(start, "segments")
    while True:
        known = open_
        for done in settled:
            known = known.unionByName(done)
        jump = known.select(F.col("conv").alias("c"), F.col("node").alias("of"), F.col("head").alias("further"), F.col("place").alias("more"))
        moved = written(
            open_.join(jump, same("conv", "c") & (F.col("head") == F.col("of"))).select(
                *counted.columns, "above", F.col("further").alias("head"), (F.col("place") + F.col("more")).alias("place"), (F.col("more") > 0).alias("moved")
            ),
            "segments",
        )
        settled.append(moved.where(~F.col("moved")).drop("moved"))
        open_ = moved.where("moved").drop("moved")
        if open_.isEmpty():
            state = settled[0]
            for done in settled[1:]:
                state = state.unionByName(done)
            return written(state, "segments")


def branches(nodes: DataFrame, top: int | None = None, trees: bool = False) -> DataFrame:
    """conv, leaf, rank and depth, with role and text, of every message of the chosen branches.

    ``nodes``: conv, node (long), parent (long), role, text, score (double). ``top``: branches of a conversation; None for all.
    ``trees``: the caller knows that no message is repeated or above itself, so that this need not be seen to.
    """
    state = segments(nodes if trees else as_trees(nodes))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    runs = written(
        state.groupBy("conv", "head").agg(
            F.count(F.lit(1)).alias("size"),
            F.sum("score").alias("score"),
            F.max(F.when(F.col("node") == F.col("head"), F.col("above"))).alias("above"),
            F.max(F.when(F.col("n_replies") == 0, F.col("node"))).alias("leaf"),
        ),
        "runs",
    )
    heads = state.select(F.col("conv").alias("c"), F.col("node").alias("of"), F.col("head").alias("up"))
    linked = written(
        runs.join(heads, same("conv", "c") & (F.col("above") == F.col("of")), "left").select("conv", "head", "size", "score", "leaf", "up"), "linked"
    )
    step = written(linked.where(F.col("leaf").isNotNull()).select("conv", "leaf", "head", "size", "score", "up", F.lit(0).alias("level")), "climb")
    paths = step
    by_head = linked.select(F.col("conv").alias("c"), F.col("head").alias("h"), F.col("size").alias("hs"), F.col("score").alias("hx"), F.col("up").alias("hu"))
    while not step.where(F.col("up").isNotNull()).isEmpty():
        step = written(
            step.where(F.col("up").isNotNull()).join(by_head, same("conv", "c") & (F.col("up") == F.col("h"))).select(
                "conv", "leaf", F.col("h").alias("head"), F.col("hs").alias("size"), F.col("hx").alias("score"), F.col("hu").alias("up"), (F.col("level") + 1).alias("level")
            ),
            "climb",
        )
        paths = paths.unionByName(step)
    ranked = paths.groupBy("conv", "leaf").agg(F.sum("score").alias("total")).withColumn("rank", F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("total"), "leaf")))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    chosen = ranked.select(F.col("conv").alias("c"), F.col("leaf").alias("l"), "rank")
    before = F.sum("size").over(Window.partitionBy("conv", "leaf").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1))
    spans = (
        paths.withColumn("before", F.coalesce(before, F.lit(0)))
        .join(chosen, same("conv", "c") & (F.col("leaf") == F.col("l")))
        .select(F.col("conv").alias("cc"), "leaf", "rank", F.col("head").alias("hh"), "before")
    )
    return state.join(spans, same("conv", "cc") & (F.col("head") == F.col("hh"))).select("conv", "leaf", "rank", (F.col("before") + F.col("place")).alias("depth"), "role", "text")


def format_branches(nodes: DataFrame, top: int | None = None, trees: bool = False) -> DataFrame:
    """conv, leaf, rank and conversation (the formatted text) of the chosen branches."""
    pieces = branches(nodes, top, trees).select("conv", "leaf", "rank", "depth", formatted(F.col("role"), F.col("text")).alias("piece"))
    return pieces.groupBy("conv", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", "piece"))).alias("pieces")).select(
        "conv", "leaf", "rank", F.array_join(F.col("pieces.piece"), "").alias("conversation")
    )


def linear_trees(turns: DataFrame) -> DataFrame:
    """Conversations by turn (ties: role, then text) as trees in which each message replies to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return turns.select(F.col("conv_id").alias("conv"), node.alias("node"), F.when(node > 1, node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
