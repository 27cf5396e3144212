"""Multi-party perspective rotation of conversations.

For every participant the dialogue is rendered with that speaker as the
assistant and all others as named users.  The result is a row for each
rendered turn with its place in the rendered dialogue, so that a conversation
of any length stays spread over many rows; character offsets say where each
turn stands and which span is trained on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns (by their number) whose running sums are made in one group.
BLOCK = 256
#: The marks around a turn.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def rotate(turns: DataFrame, system: str = "system") -> DataFrame:
    """conv_id, perspective, seq, chat_role, name, rendered, char_start, char_end, loss_start, loss_end.

    Participants of a conversation are its distinct roles but ``system``, whose
    turns keep that role in every rendering and are never trained on.  Turns
    go by (turn, role, text), nulls first; repeated rows are turns of their own.
    A null role is a speaker named "unknown", null text is empty, and rows
    without a conv_id form one conversation.  A conversation without
    participants has no rows.  The loss span (the assistant's text and end
    mark) is null for all other turns.  Extra columns are ignored.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    people = rows.where(F.col("role") != system).select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    own = F.col("role") == F.col("perspective")
    chat_role = F.when(F.col("role") == system, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when((F.col("role") != system) & ~own, F.col("role"))
    head = F.concat(F.lit(BEGIN), F.col("chat_role"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("\n"))
    shown = (rows.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
             .withColumn("chat_role", chat_role).withColumn("name", name).withColumn("head", head)
             .withColumn("rendered", F.concat("head", "text", F.lit(END)))
             .withColumn("size", F.char_length("rendered").cast("bigint"))
             .withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK)))
    # Running sums in two steps: over the blocks of a rendering, then within each block.
    totals = shown.groupBy("conv_id", "perspective", "block").agg(F.sum("size").alias("chars"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"),
                            F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars0"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    within = Window.partitionBy("conv_id", "perspective", "block").orderBy("turn", "role", "text")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    placed = (shown.withColumn("n", F.row_number().over(within)).withColumn("end", F.sum("size").over(upto))
              .join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
              .withColumn("char_end", F.col("chars0") + F.col("end"))
              .withColumn("char_start", F.col("char_end") - F.col("size")))
    mine = F.col("chat_role") == "assistant"
    return placed.select(
        "conv_id", "perspective", (F.col("n0") + F.col("n")).alias("seq"), "chat_role", "name", "rendered", "char_start", "char_end",
        F.when(mine, F.col("char_start") + F.char_length("head")).alias("loss_start"), F.when(mine, F.col("char_end")).alias("loss_end"))
