"""Multi-party chat formatting by perspective rotation, in DataFrame operations alone.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and all others as named users; the mask has the spans of the assistant's own
words, which a trainer learns. A system turn stays a system turn in every rendering and is
no participant.

Conversations are dealt by (conversation, block of consecutive turns), so a conversation of
any length spreads over many tasks; one of fewer than ``block_turns`` turns is one block.
Texts move once: participants are gathered from the speakers alone and meet the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rotate_perspectives(turns: DataFrame, *, block_turns: int = 256) -> DataFrame:
    """turns (conv_id, turn, role: the speaker, text, ...) -> a row for each block of each participant's rendering.

    Columns: conv_id, perspective, block (0 for the first ``block_turns`` turn numbers),
    n_turns, n_own, text, mask (``start-end`` pairs in characters of text, end exclusive,
    joined by commas: the speaker's words and the closing mark), own_chars. Turns are in
    order of turn, speaker and text; repeated rows stay. A null speaker is the participant
    ``unknown``, a null text is empty, a null turn comes first in block -1, a null conv_id
    is a conversation of its own. A conversation of system turns alone has no participant
    and no row. Other columns are ignored, whatever their names.
    """
    said = turns.select(
        F.col("conv_id").cast("long").alias("conv"),
        F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-1)).cast("long").alias("block"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    speakers = said.groupBy("conv", "block").agg(F.collect_set("speaker").alias("speakers"))  # no texts
    people = speakers.select("conv", F.explode("speakers").alias("who")).where("who <> 'system'").groupBy("conv").agg(F.collect_set("who").alias("people"))
    people = people.withColumnRenamed("conv", "of")
    wanted = speakers.select(F.col("conv").alias("c"), F.col("block").alias("b")).join(people, F.col("c").eqNullSafe(F.col("of"))).select("c", "b", "people")
    blocks = said.groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "text"))).alias("turns"))  # at most the turns of a block
    each = blocks.join(wanted, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    each = each.select("conv", "block", "turns", F.explode("people").alias("me"))

    def head(t: Column) -> Column:
        role = F.when(t["speaker"] == F.col("me"), "assistant").when(t["speaker"] == "system", "system").otherwise(F.concat(F.lit("user name="), t["speaker"]))
        return F.concat(F.lit(OPEN), role, F.lit("\n"))

    def add(done: Column, p: Column) -> Column:
        begin = done["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.concat_ws("-", begin.cast("string"), end.cast("string"))
        return F.struct(
            (end + 1).alias("at"),
            F.when(p["own"], F.concat_ws(",", F.when(done["mask"] != "", done["mask"]), span)).otherwise(done["mask"]).alias("mask"),
            (done["chars"] + F.when(p["own"], F.length(p["body"])).otherwise(0)).alias("chars"),
        )

    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"), (t["speaker"] == F.col("me")).alias("own")))
    each = each.select("conv", "block", "me", parts.alias("parts"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("mask"), F.lit(0).alias("chars"))
    each = each.withColumn("sum", F.aggregate("parts", start, add))
    return each.select(
        F.col("conv").alias("conv_id"),
        F.col("me").alias("perspective"),
        "block",
        F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        F.col("sum.mask").alias("mask"),
        F.col("sum.chars").cast("long").alias("own_chars"),
    )
