"""Chat formatting from event logs.

A log holds one event a row: a message that begins, a delta that goes on with it, an edit or a regeneration that
replaces what it says so far. Events are folded into final messages in the order of their sequence numbers and
rendered with a template. Conversations of any length are rendered in chunks of bounded sequence ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Sequence numbers to a chunk.
CHUNK = 256
#: What an event does; those of one sequence number take effect in this order.
MESSAGE, REGENERATE, EDIT, DELTA = "message", "regenerate", "edit", "delta"


def escape(text: Column) -> Column:
    """text in a form that holds no <|; see unescape."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    """A role in a form that holds neither <| nor a line break."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """What escape() or escape_role() was given."""
    plain = F.transform(F.split(text, r"\\\\"), lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")))
    return F.array_join(plain, "\\")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, seq, message, part, role, text): the final messages of events(conv_id, seq, op, message, role, text).

    op: 'message' begins a message, 'delta' appends to it, 'edit' and 'regenerate' replace it; null or unknown ones
    count as 'message'. Events belong together by conv_id and message; a second 'message' event of one key begins a
    further message (part 2, and so on), and deltas follow the latest part. Events of one seq take effect as
    message, regenerate, edit, delta, then by role and text, nulls first. role is the latest that is not null, else
    empty; null texts count as empty. seq is the first event's, null before all others. An empty log gives an empty
    result. Further columns are not read.
    """
    op = F.when(F.col("op").isin(REGENERATE, EDIT, DELTA), F.col("op")).otherwise(MESSAGE)
    rank = F.when(op == MESSAGE, 0).when(op == REGENERATE, 1).when(op == EDIT, 2).otherwise(3)
    log = events.select("conv_id", F.col("seq").cast("long").alias("seq"), rank.alias("rank"), "message", "role", F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id", "message").orderBy("seq", "rank", "role", "text")
    log = log.withColumn("at", F.row_number().over(order)).withColumn("part", F.sum(F.when(F.col("rank") == 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("conv_id", "message", "part")
    log = log.withColumn("reset", F.max(F.when(F.col("rank") < 3, F.col("at"))).over(whole))
    said = F.when(F.col("at") >= F.coalesce("reset", F.lit(0)), F.struct("at", "text"))
    folded = log.groupBy("conv_id", "message", "part").agg(
        F.min_by("seq", "at").alias("seq"), F.max(F.when(F.col("role").isNotNull(), F.struct("at", "role")))["role"].alias("role"), F.array_sort(F.collect_list(said))["text"].alias("texts")
    )
    return folded.select("conv_id", "seq", "message", "part", F.coalesce("role", F.lit("")).alias("role"), F.array_join("texts", "").alias("text"))


def format_messages(messages: DataFrame, assistant: str = "assistant", chunk: int = CHUNK) -> DataFrame:
    """(conv_id, chunk, formatted, loss_spans) of fold_events()'s messages.

    A conversation's formatted text is its chunks' in order; null sequence numbers are in the null chunk, before
    the others. Each turn is <|im_start|>role, a line break, its text, <|im_end|>, a line break; roles and texts are
    escaped. loss_spans are (start, end) of the assistant's escaped texts in the chunk, in code points. Rows that repeat
    are turns of their own; those of one sequence number go by message, part, role and text. Null roles and texts count
    as empty. No messages give no chunks. Further columns are not read.
    """
    turn = F.struct("seq", "message", "part", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    chunks = messages.withColumn("chunk", F.floor(F.col("seq") / chunk)).groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    chunks = chunks.withColumn(
        "turns", F.transform("turns", lambda t: F.struct((t["role"] == assistant).alias("loss"), F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body")))
    )
    tail = F.lit(END + "\n")
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        own = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + F.length(tail)).cast("long").alias("at"), F.when(t["loss"], F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return chunks.select(
        "conv_id", "chunk", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], tail)), "").alias("formatted"), F.aggregate("turns", begin, step)["spans"].alias("loss_spans")
    )


def read_back(chunks: DataFrame) -> DataFrame:
    """(conv_id, chunk, turns, loss, chars) of format_messages()'s chunks, from their text and spans alone.

    turns: array of (role, text), unescaped; loss: the unescaped texts under the loss mask, in order. Each chunk gives a
    row, repeated ones too; a null text gives nulls; no chunks give no rows.
    """
    parts = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(END) - 1)
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    return chunks.select("conv_id", "chunk", F.transform(parts, turn).alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("chars"))
