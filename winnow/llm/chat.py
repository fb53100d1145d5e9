"""Chat rendering from every participant's side; DataFrame operations only.

For each speaker of a conversation the dialogue is rendered once more: that speaker's turns are
the assistant's, system turns stay system turns, and all others are users with their names:

    <|im_start|>assistant\\n...<|im_end|>\\n
    <|im_start|>user name=NAME\\n...<|im_end|>\\n

The mask is a list of [start, end) character spans of the rendered text that are trained on: the
content and end mark of each of the speaker's own turns. Control marks in contents and names cannot
be mistaken: a backslash follows each `<|` there (take it away again to get the original).

A conversation is rendered in parts of `part_turns` turn numbers, so that no task holds more of it;
most have one part. The parts of a perspective, put together in order, are its whole dialogue; spans
count from the beginning of their part.

Defined results: a conversation without turns by anyone but the system gives no rows; a null or
empty role speaks as "unknown"; a null text is empty; turns are in order of number (nulls last), then role and
text, and repeated rows are repeated turns; rows without a conversation id are a conversation each,
with a null id, as nothing says which belong together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 256
SYSTEM = "system"


def _escaped(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("<|\\"))


def _turns(chats: DataFrame, part_turns: int) -> DataFrame:
    speaker = F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit("unknown"))
    part = F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(2**62))
    return chats.select(
        F.col("conv_id"),
        F.col("turn"),
        part.alias("part"),
        speaker.alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
        (F.lower(speaker) == SYSTEM).alias("is_system"),
    )


def _turn(t: Column, perspective: Column) -> Column:
    """A rendered turn, behind what turns are sorted by; `head`: length of what precedes its content."""
    own = (t["speaker"] == perspective) & ~t["is_system"]
    # A line break in a name would end the header.
    name = F.translate(_escaped(t["speaker"]), "\r\n", "  ")
    role = F.when(t["is_system"], SYSTEM).when(own, "assistant").otherwise(F.concat(F.lit("user name="), name))
    head = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"))
    return F.struct(
        t["turn"].isNull().alias("last"),
        t["turn"].alias("turn"),
        t["speaker"].alias("speaker"),
        t["text"].alias("text"),
        F.concat(head, _escaped(t["text"]), F.lit("<|im_end|>\n")).alias("segment"),
        own.alias("own"),
        F.length(head).alias("head"),
    )


def _rendered(turns: Column) -> list[Column]:
    """Text and mask of sorted turns."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("mask"))

    def add(acc: Column, t: Column) -> Column:
        # The line break behind the end mark is no part of the turn.
        span = F.struct(
            (acc["at"] + t["head"]).alias("start"), (acc["at"] + F.length(t["segment"]) - 1).alias("end")
        )
        mask = F.when(t["own"], F.concat(acc["mask"], F.array(span))).otherwise(acc["mask"])
        return F.struct((acc["at"] + F.length(t["segment"])).alias("at"), mask.alias("mask"))

    return [
        F.array_join(F.transform(turns, lambda t: t["segment"]), "").alias("text"),
        F.aggregate(turns, zero, add, lambda acc: acc["mask"]).alias("mask"),
    ]


def perspectives(chats: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, perspective, part (from 0), n_turns, text and mask, for every speaker but the system.

    chats: conv_id, turn, role, text.
    """
    turns = _turns(chats.select("conv_id", "turn", "role", "text"), part_turns)
    named = turns.filter("conv_id IS NOT NULL")
    speakers = named.filter("NOT is_system").select("conv_id", F.col("speaker").alias("perspective")).distinct()
    # Parts of a conversation first, so that its speakers meet one row per part.
    parts = named.groupBy("conv_id", "part").agg(F.collect_list(F.struct("turn", "speaker", "text", "is_system")).alias("turns"))
    # Parts are numbered by their names alone; the turns stay out of that sort.
    order = Window.partitionBy("conv_id").orderBy("part")
    numbers = named.select("conv_id", "part").distinct().withColumn("number", (F.row_number().over(order) - 1).cast("long"))
    met = parts.join(numbers, ["conv_id", "part"]).join(speakers, "conv_id")
    rows = met.select("conv_id", F.col("number").alias("part"), "perspective", "turns")
    listed = F.array_sort(F.transform("turns", lambda t: _turn(t, F.col("perspective"))))
    whole = rows.select("conv_id", "part", "perspective", listed.alias("turns"))
    lone = turns.filter("conv_id IS NULL AND NOT is_system").withColumn("perspective", F.col("speaker"))
    lone = lone.select(
        "conv_id",
        F.lit(0).cast("long").alias("part"),
        "perspective",
        F.array(_turn(F.struct("turn", "speaker", "text", "is_system"), F.col("perspective"))).alias("turns"),
    )
    both = whole.unionByName(lone)
    return both.select("conv_id", "perspective", "part", F.size("turns").cast("long").alias("n_turns"), *_rendered(F.col("turns")))
