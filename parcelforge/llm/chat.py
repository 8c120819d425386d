"""Chat formatting of reply trees, in DataFrame operations only.

Messages form trees by their parents.  Self-joins on the parent, doubled in reach each time, list the path from each
leaf to its root: after k rounds a table holds, for each message, the ancestor 2^k steps up; going through these tables
from the longest reach down adds every ancestor of a leaf once.  So a tree of depth d takes 2 log2(d) joins, not d.
Branches are ranked by their mean score; the chosen paths are formatted as one conversation each.

Template: `<turn ROLE>TEXT</turn>` and a newline per message.  In roles and texts a backslash is written `\\b`, `<` as
`\\l` and `>` as `\\g`, so that no text can hold a control string, and replacing `\\l`, `\\g`, `\\b` in this order gives the
text back.  The loss mask lists the code points (end exclusive) that assistant texts take in the formatted conversation.

Defined results: null roles and texts are empty, null scores 0; messages whose parent isn't there are roots; rows that
repeat a message id of their tree are one message, that of the smallest (parent, role, text, score) (`thread_messages`
numbers rows, so that there each is a message of its own); a null conversation id is one conversation; messages without
an id can't be placed and are left out, as are those on a cycle, which hang below no root; ties of the score go to the
smallest leaf id.  One conversation is one row, so it must fit into a task's memory, as any formatted text must.
Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.llm.common import written

ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))


def thread_messages(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the messages of a tree without branches: each replies to the one before.
    Equal turns are ordered by role and text."""
    rows = rows.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return rows.withColumn("message_id", at.cast("long")).select("conv_id", "message_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1).alias("parent_id"), "role", "text", F.lit(1.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """(conv_id, leaf_id, message_id, distance): the messages on the path of each leaf, 0 steps for the leaf itself.

    Reads only ids.  Each round's table is written to the shared folder, so that a lost executor costs one round.
    """
    ids = written(messages.select("conv_id", "message_id", "parent_id"), "chat-ids")
    known = ids.select("conv_id", F.col("message_id").alias("parent_id"))
    reach = [written(ids.join(known.distinct(), ["conv_id", "parent_id"]).select("conv_id", "message_id", F.col("parent_id").alias("up")), "chat-1")]
    limit = ids.count().bit_length()  # a chain of all messages needs no more; only cycles have more
    while len(reach) <= limit:
        low, high = reach[-1].alias("a"), reach[-1].alias("b")
        longer = low.join(high, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.up") == F.col("b.message_id"))).select("a.conv_id", "a.message_id", F.col("b.up").alias("up"))
        longer = written(longer, f"chat-{2 ** len(reach)}")
        if longer.isEmpty():
            break
        reach.append(longer)
    leaves = ids.join(reach[0].select("conv_id", F.col("up").alias("message_id")).distinct(), ["conv_id", "message_id"], "left_anti")
    found = leaves.select("conv_id", F.col("message_id").alias("leaf_id"), "message_id", F.lit(0).cast("long").alias("distance"))
    for k in range(len(reach) - 1, -1, -1):
        step = found.join(reach[k], ["conv_id", "message_id"]).select("conv_id", "leaf_id", F.col("up").alias("message_id"), (F.col("distance") + 2**k).alias("distance"))
        found = found.union(step)
        if k % 3 == 0:
            found = written(found, "chat-paths")
    return found


def formatted(messages: DataFrame, best: int | None = 1, unique: bool = False) -> DataFrame:
    """(conv_id, branch_rank, leaf_id, score, n_turns, formatted, loss_mask) of the `best` paths of each tree (all: None).

    `messages`: (conv_id, message_id, parent_id, role, text, score); `unique`: no message id is there twice in a tree.
    loss_mask: array of (start, end), code points.
    """
    kind = messages.schema["conv_id"].dataType
    # null is a conversation like others: the joins below need a key that is never null
    conv = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit("0").cast(kind)).alias("id"))
    messages = messages.where("message_id is not null")
    messages = messages.select(conv.alias("conv_id"), "message_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    if not unique:
        messages = messages.groupBy("conv_id", "message_id").agg(F.min(F.struct("parent_id", "role", "text", "score")).alias("m")).select("conv_id", "message_id", "m.*")
    steps = paths(messages)
    # branches are ranked by scores alone; texts are fetched for the chosen ones
    scores = steps.join(messages.select("conv_id", "message_id", "score"), ["conv_id", "message_id"]).groupBy("conv_id", "leaf_id").agg(F.avg("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf_id"))
    chosen = scores.withColumn("branch_rank", rank)
    chosen = chosen if best is None else chosen.where(F.col("branch_rank") <= best)
    on_path = steps.join(chosen, ["conv_id", "leaf_id"]).join(messages.select("conv_id", "message_id", "role", "text"), ["conv_id", "message_id"])
    head = F.concat(F.lit("<turn "), escaped(F.col("role")), F.lit(">"))
    body = escaped(F.col("text"))
    turns = on_path.select("conv_id", "leaf_id", "score", "branch_rank", F.struct((-F.col("distance")).alias("at"), (F.col("role") == ASSISTANT).alias("loss"), head.alias("head"), body.alias("body")).alias("turn"))
    branches = turns.groupBy("conv_id", "leaf_id", "score", "branch_rank").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    # lengths run along the turns; each step costs one struct, whatever the texts
    widths = F.transform("turns", lambda t: F.struct(F.length(t["head"]).alias("head"), F.length(t["body"]).alias("body"), t["loss"].alias("loss")))
    empty = F.struct(F.lit(0).alias("end"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("mask"))

    def add(acc: Column, w: Column) -> Column:
        start = acc["end"] + w["head"]
        end = start + w["body"]
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct((end + len("</turn>\n")).alias("end"), F.when(w["loss"], F.array_append(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    text = F.concat(F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"])), "</turn>\n"), F.lit("</turn>\n"))
    return branches.select(F.when(~F.col("conv_id.none"), F.col("conv_id.id")).alias("conv_id"), "branch_rank", "leaf_id", "score", F.size("turns").alias("n_turns"), text.alias("formatted"), F.aggregate(widths, empty, add)["mask"].alias("loss_mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """Adds `turns`, array of (role, text) parsed from `formatted`, and `loss_text`, what lies under the mask, unescaped."""
    lines = F.filter(F.split("formatted", "</turn>\n"), lambda x: x != "")
    parts = F.transform(lines, lambda x: F.split(F.substring(x, F.lit(len("<turn ") + 1), F.length(x)), ">", 2))
    turns = F.transform(parts, lambda p: F.struct(unescaped(p[0]).alias("role"), unescaped(p[1]).alias("text")))
    masked = F.transform("loss_mask", lambda m: unescaped(F.substring(F.col("formatted"), m["start"] + 1, m["end"] - m["start"])))
    return chats.withColumns({"turns": turns, "loss_text": F.array_join(masked, "")})


def chat_digest(rows: DataFrame) -> DataFrame:
    """Of (conv_id, turn, role, text): per conversation, what is read back from its formatted form."""
    back = read_back(formatted(thread_messages(rows), unique=True))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
