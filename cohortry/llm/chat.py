"""Chat formatting of logged conversations, each kept in its longest logged state.

Logs hold snapshots: a conversation is logged after some turns and again, under another id, after
more. A rolling hash over a conversation's turns names each of its prefixes; a conversation whose
whole is a proper prefix of another is removed by an anti-join on (length, hash), and of equal
conversations the smallest id stays. What is left is rendered.

The rolling hash of k turns combines hashes of (position, role, text), 128 bits wide, so prefix
hashes are running aggregates. Equal prefixes are merged before they are joined, however many
conversations begin alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.staging import stage

#: How a turn is written.
TURN = "<|im_start|>{role}\n{text}<|im_end|>\n"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text and place: the turns in order of turn, then role, then text, from 1."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", "turn", "role", "text").withColumn(
        "place", F.row_number().over(order)
    )


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, low, high, length): the rolling hash up to each turn, and all turns."""
    of_turn = [
        F.xxhash64(F.lit(seed), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
        for seed in (1, 2)
    ]
    whole = Window.partitionBy("conv_id")
    so_far = whole.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return turns.select(
        "conv_id",
        "place",
        F.bit_xor(of_turn[0]).over(so_far).alias("low"),
        F.bit_xor(of_turn[1]).over(so_far).alias("high"),
        F.count("*").over(whole).alias("length"),
    )


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, length, copies): conversations that are no proper prefix of another.

    Of equal ones the smallest id stands for all (null before others); copies counts them.
    """
    hashes = stage(prefix_hashes(numbered_turns(conversations)), "prefix-hashes")
    name = ["place", "low", "high"]
    wholes = (
        hashes.filter("place = length")
        .groupBy(*name)
        .agg(F.min(F.struct("conv_id")).alias("first"), F.count("*").alias("copies"))
    )
    begun = hashes.filter("place < length").select(*name).distinct()
    return wholes.join(begun, name, "left_anti").select(
        F.col("first.conv_id").alias("conv_id"), F.col("place").cast("long").alias("length"), "copies"
    )


def _rendered(role: Column, text: Column) -> Column:
    head, rest = TURN.split("{role}")
    middle, tail = rest.split("{text}")
    blank = F.lit("")
    return F.concat(
        F.lit(head), F.coalesce(role, blank), F.lit(middle), F.coalesce(text, blank), F.lit(tail)
    )


def chat_texts(conversations: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, copies and its rendered text.

    Turns are ordered by turn, then role, then text, nulls first; repeated rows are turns of their
    own. Rows without conv_id form one conversation. A null role or text differs from an empty one
    in the hashes and is rendered as empty. Very long conversations become very long texts. An empty
    table gives no rows. Other columns of the input are not read.
    """
    turns = numbered_turns(conversations)
    kept = stage(maximal_conversations(conversations), "maximal")
    texts = (
        turns.join(kept.select(F.col("conv_id").alias("kept_id")), F.col("conv_id").eqNullSafe(F.col("kept_id")), "left_semi")
        .groupBy("conv_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("place", _rendered(F.col("role"), F.col("text")).alias("turn")))).alias("turns")
        )
        .select("conv_id", F.array_join("turns.turn", "").alias("text"))
    )
    named = texts.withColumnRenamed("conv_id", "text_id")
    return kept.join(named, F.col("conv_id").eqNullSafe(F.col("text_id"))).select(
        "conv_id", F.col("length").alias("n_turns"), "copies", "text"
    )
