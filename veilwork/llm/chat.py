"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted by (turn, role, text), and written as

    <|im_start|>role<|im_sep|>text<|im_next|>text<|im_end|>\\n

where <|im_next|> separates adjacent turns of one role, which share a message. Control strings inside roles and texts
are made harmless by one more bar after each ``<|``, which the reader takes away again, so formatting is reversible. The
loss mask covers the assistant's texts alone.

A long conversation is collected in blocks of BLOCK turns first, so that what one task merges is a row for each block.
A conversation's formatted text is one value by nature; nothing else of it meets in one task.

Cases: null text and role count as empty; null turn sorts first; turns with equal numbers are sorted by role and text;
repeated rows stay; null conv_id is one conversation; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 256
START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\|+)", "<$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\|+)\|", "<$1")


def chats(turns: DataFrame) -> DataFrame:
    """conv_id, segments (array of text and loss: their texts joined are the formatted text), formatted."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = turns.select("conv_id", F.floor(F.col("turn") / BLOCK).alias("block"), turn.alias("t")).groupBy("conv_id", "block").agg(F.collect_list("t").alias("ts"))
    sorted_turns = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", F.array_sort("ts").alias("ts")))), lambda b: b["ts"]))
    whole = blocks.groupBy("conv_id").agg(sorted_turns.alias("ts"))
    # each turn beside the one before it: a turn of the same role goes on in the open message
    pairs = F.zip_with("ts", F.expr("concat(array(named_struct('turn', cast(null as bigint), 'role', cast(null as string), 'text', '')), slice(ts, 1, size(ts) - 1))"), lambda t, p: F.struct(t.alias("t"), p["role"].alias("before")))

    def pieces(x: Column, i: Column) -> Column:
        role = F.concat(F.lit(START), escape(x["t"]["role"]), F.lit(SEP))
        head = F.when(x["before"].isNull(), role).when(x["before"] == x["t"]["role"], F.lit(NEXT)).otherwise(F.concat(F.lit(END + "\n"), role))
        return F.array(F.struct(head.alias("text"), F.lit(False).alias("loss")), F.struct(escape(x["t"]["text"]).alias("text"), (x["t"]["role"] == LEARNED).alias("loss")))

    segments = F.concat(F.flatten(F.transform(pairs, pieces)), F.array(F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss"))))
    out = whole.select("conv_id", segments.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text), learned (array of the texts under the mask, unescaped), formatted."""
    messages = F.split("formatted", r"<\|im_start\|>")
    messages = F.filter(messages, lambda m, i: i > 0)

    def turns(m: Column) -> Column:
        role = unescape(F.substring_index(m, SEP, 1))
        body = F.substring_index(F.substring_index(m, SEP, -1), END, 1)
        return F.transform(F.split(body, r"<\|im_next\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    learned = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return formatted.select("conv_id", F.flatten(F.transform(messages, turns)).alias("turns"), learned.alias("learned"), "formatted")
