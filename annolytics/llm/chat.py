"""Chat rendering by multi-party perspective rotation, with DataFrame functions alone.

For every participant of a dialogue there is one rendering in which that speaker is the assistant and all others are
users with their names; a ``system`` turn is an instruction and belongs to nobody. Turns are written as
``<|im_start|>role`` (users: ``user name=...``), a line break, the text, ``<|im_end|>`` and a line break. The mask holds
the spans of what the assistant says, closing mark included, in code points of the rendering, end exclusive. Marks
that a text or a name holds are broken up by a space after ``<``, so that no text can end its own turn.

A dialogue is rendered in parts of at most ``turns`` turns (a parameter), each with its system turns as they fall, so
no row grows with the length of a dialogue; turns are numbered over the whole table, in any number of tasks.

Defined cases: a null speaker is called ``unknown``; a null or empty text is an empty turn; turns stand by number (null
last), then speaker and text, and repeated turns stay; a null dialogue id is a dialogue of its own kind; dialogues
without a participant (system turns alone) have no rendering; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.operators.windows import number_rows

OPEN, CLOSE, SYSTEM = "<|im_start|>", "<|im_end|>", "system"
TURNS = 64


def unmarked(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate(
    df: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text",
    *, turns: int = TURNS,
) -> DataFrame:
    """``conv_id, perspective, part, n_turns, n_masked, rendered, mask`` for each participant and part of a dialogue.

    A part in which a participant says nothing is rendered too, with an empty mask.
    """
    rows = df.select(
        F.col(id_column).alias("_id"), F.col(turn_column).alias("_turn"), F.coalesce(F.col(role_column), F.lit("unknown")).alias("_role"),
        F.coalesce(F.col(text_column), F.lit("")).alias("_text"),
    ).withColumns({"_last": F.col("_turn").isNull(), "_key": F.coalesce(F.col("_id").cast("string"), F.lit("\x00"))})
    numbered = number_rows(rows, ["_last", "_turn", "_role", "_text"], ["_key"], "_number")
    parts = numbered.groupBy("_key", "_id", F.floor((F.col("_number") - 1) / turns).cast("int").alias("part")).agg(
        F.sort_array(F.collect_list(F.struct(
            "_number", F.col("_role").alias("role"), unmarked(F.col("_role")).alias("name"), unmarked(F.col("_text")).alias("text")
        ))).alias("_turns")  # at most ``turns`` entries
    )
    speakers = numbered.where(F.col("_role") != SYSTEM).select("_key", F.col("_role").alias("perspective")).distinct()
    # within each part its own rotation; who speaks in the dialogue is known for all its parts
    both = parts.join(speakers, "_key")

    def head(x: Column) -> Column:
        role = F.when(x["role"] == SYSTEM, F.lit(SYSTEM)).when(x["role"] == F.col("perspective"), F.lit("assistant")).otherwise(
            F.concat(F.lit("user name="), x["name"])
        )
        return F.concat(F.lit(OPEN), role, F.lit("\n"))

    written = both.withColumn("_pieces", F.transform("_turns", lambda x: F.struct(
        head(x).alias("head"), F.concat(x["text"], F.lit(CLOSE)).alias("body"), (x["role"] == F.col("perspective")).alias("own")
    )))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.char_length(x["head"])
        end = begin + F.char_length(x["body"])
        span = F.concat_ws(":", begin.cast("string"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(x["own"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate("_pieces", start, step)["spans"]
    return written.select(
        F.col("_id").alias(id_column), "perspective", "part", F.size("_turns").cast("long").alias("n_turns"),
        F.size(F.filter("_pieces", lambda x: x["own"])).cast("long").alias("n_masked"),
        F.array_join(F.transform("_pieces", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("rendered"),
        F.array_join(spans, ",").alias("mask"),
    )
