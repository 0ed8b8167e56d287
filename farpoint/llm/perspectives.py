"""Dialogues of several parties rendered from the perspective of each party."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.operators.numbering import running_total
from farpoint.session import materialize

SYSTEM = "system"
NOBODY = "unknown"
END = "<|end|>\n"
ASSISTANT_HEAD, SYSTEM_HEAD = "<|assistant|>\n", "<|system|>\n"
# Characters after which a dialogue goes on in another row, at the next message.
PART_CHARS = 65_536


def escaped(text: Column) -> Column:
    """Text in which no header or end mark can occur; ``<||`` stands for ``<|``."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def header(speaker: Column, assistant: Column) -> Column:
    """Header of a message as the assistant's perspective has it."""
    named = F.concat(F.lit("<|user name="), F.translate(escaped(speaker), "\n|>", "   "), F.lit("|>\n"))
    return F.when(speaker == F.lit(SYSTEM), F.lit(SYSTEM_HEAD)).when(speaker == assistant, F.lit(ASSISTANT_HEAD)).otherwise(named)


def rotate_perspectives(
    messages: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """One row per conversation, participant and part: the dialogue with that participant as assistant.

    Columns: the conversation, ``assistant``, ``part`` from 0, ``rendered``, ``n_messages``,
    ``mask_starts`` and ``mask_ends``: the character spans to train on, which are the assistant's own texts with their
    end marks. The other speakers are users with their names; system messages stay what they are and
    have no perspective. Messages are in order of turn, then speaker and text.

    A dialogue goes on in a further part after ``part_chars`` characters, so a conversation of any length is
    never gathered as a whole: offsets are distributed running sums, and a row gathers one part. Rows without a
    conversation form one conversation; a NULL turn comes first; a NULL role is the speaker ``unknown``; NULL text is
    empty. Repeated rows are messages of their own. A conversation of system messages alone has no rows, and an
    empty table none. Other columns are not read.
    """
    read = messages.select(
        F.col(f"`{conversation}`").alias("_c"),
        F.col(f"`{turn}`").alias("_t"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(NOBODY)).alias("_s"),
        escaped(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_x"),
        F.monotonically_increasing_id().alias("_m"),
    )
    stored = materialize(read, "messages")
    narrow = stored.select("_c", "_t", "_s", "_m", F.xxhash64("_x").alias("_h"), F.char_length("_x").alias("_n"))
    people = stored.where(F.col("_s") != SYSTEM).select(F.col("_c").alias("_pc"), F.col("_s").alias("_p")).distinct()
    views = narrow.join(people, F.col("_c").eqNullSafe(F.col("_pc"))).drop("_pc")
    size = F.char_length(header(F.col("_s"), F.col("_p"))) + F.col("_n") + len(END)
    views = views.withColumn("_size", size.cast("bigint")).withColumn("_nil", F.col("_t").isNotNull())
    placed = running_total(views, "_size", ["_nil", "_t", "_s", "_h", "_m"], ["_c", "_p"], "_end")
    start = F.col("_end") - F.col("_size")
    placed = placed.select("_c", "_p", "_m", start.alias("_start"), F.floor(start / part_chars).cast("bigint").alias("_part"))
    # Parts are numbered without gaps even if one message is longer than a part.
    parts = materialize(placed, "placed").join(stored.select("_m", "_s", "_x"), "_m")
    head = header(F.col("_s"), F.col("_p"))
    piece = F.struct("_start", F.concat(head, "_x", F.lit(END)).alias("r"), F.char_length(head).alias("h"), (F.col("_s") == F.col("_p")).alias("own"))
    gathered = parts.groupBy("_c", "_p", "_part").agg(F.sort_array(F.collect_list(piece)).alias("_l"), F.min("_start").alias("_first"))
    own = F.filter("_l", lambda x: x["own"])
    begin = lambda x: x["_start"] - F.col("_first")
    return gathered.select(
        F.col("_c").alias(conversation),
        F.col("_p").alias("assistant"),
        F.col("_part").alias("part"),
        F.array_join(F.transform("_l", lambda x: x["r"]), "").alias("rendered"),
        F.size("_l").cast("bigint").alias("n_messages"),
        F.transform(own, lambda x: (begin(x) + x["h"]).cast("bigint")).alias("mask_starts"),
        F.transform(own, lambda x: (begin(x) + F.char_length(x["r"])).cast("bigint")).alias("mask_ends"),
    )
