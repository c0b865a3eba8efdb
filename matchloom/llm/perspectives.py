"""Multi-party perspective rotation: a dialogue once per participant, with that speaker as assistant and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the format: what opens and closes a message.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

#: Roles that set the scene and take no part.
SCENE = ("system",)


def neutral(text: Column) -> Column:
    """Text in which the format's marks are plain text, so that no message can open or close another."""
    for mark in (OPEN, CLOSE):
        text = F.replace(text, F.lit(mark), F.lit(mark.replace("<|", "<| ")))
    return text


def _head(scene: tuple[str, ...]) -> Column:
    """What opens a message: the speaker is the assistant, scene roles keep theirs, anyone else is a user with a name."""
    role = F.col("_role")
    name = F.translate(neutral(role), "\r\n", "  ")
    who = (F.when(role.isNull(), "user").when(role == F.col("speaker"), "assistant").when(role.isin(*scene), name)
           .otherwise(F.concat(F.lit("user name="), name)))
    return F.concat(F.lit(OPEN), who, F.lit("\n"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", scene: tuple[str, ...] = SCENE) -> DataFrame:
    """One row per dialogue and participant: ``conv_col``, ``speaker``, ``first_turn``, ``n_turns``, ``text``, ``mask``.

    Every role of a dialogue but the scene's and null is a participant. In its rendering its own messages are the
    assistant's, others are users named by their roles. ``mask`` has ``(start, end)`` in characters of ``text`` of what
    is learnt: the speaker's messages with what closes them. A dialogue is rendered whole, however long it is, so a
    rendering must fit into a row; dialogues and speakers are dealt out over tasks.

    Marks of the format inside texts and names get a space after ``<|``, and line ends in names become spaces, so that
    no message forges another. Null texts are empty messages and null roles are users without a name. Null turns come
    last; rows with equal turns are ordered by role (null first) and text. Rows with a null dialogue form one dialogue.
    Repeated rows are messages of their own. A dialogue without a participant gives no row; an empty table gives an
    empty one; other columns are not read. Only DataFrame functions are used.
    """
    text = neutral(F.coalesce(F.col(text_col), F.lit("")))
    base = turns.select(F.col(conv_col).alias("_conv"), F.col(turn_col).cast("long").alias("_turn"), F.col(role_col).alias("_role"), text.alias("_text"))
    speakers = turns.select(F.col(conv_col).alias("_c"), F.col(role_col).alias("speaker")).filter(F.col("speaker").isNotNull() & ~F.col("speaker").isin(*scene)).distinct()
    seen = base.join(speakers, base["_conv"].eqNullSafe(speakers["_c"])).withColumn("_head", _head(scene))
    order = Window.partitionBy("_conv", "speaker").orderBy(F.col("_turn").asc_nulls_last(), "_role", "_text").rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumn("_end", F.sum(F.length("_head") + F.length("_text") + len(CLOSE) + 1).over(order))
    stop = F.col("_end") - 1
    learnt = F.when(F.col("_role") == F.col("speaker"), F.struct((stop - len(CLOSE) - F.length("_text")).alias("start"), stop.alias("end")))
    message = F.struct("_end", F.concat("_head", "_text", F.lit(CLOSE + "\n")).alias("m"))
    out = seen.groupBy("_conv", "speaker").agg(
        F.min("_turn").alias("first_turn"), F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(message)).alias("_all"), F.array_sort(F.collect_list(learnt)).alias("mask"))
    return out.select(F.col("_conv").alias(conv_col), "speaker", "first_turn", "n_turns", F.array_join(F.transform("_all", lambda x: x["m"]), "").alias("text"), "mask")
