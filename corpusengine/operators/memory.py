"""Conversation memory: recent turns, carried memory, sequence numbers, ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusengine.functions.text import tail as last_chars


def interaction(query: Column, answer: Column) -> Column:
    """`User: …` and `Assistant: …` lines; a missing answer reads None."""
    return F.concat(
        F.lit("User: "), query, F.lit("\nAssistant: "), F.coalesce(answer, F.lit("None"))
    )


def _latest(turns: DataFrame, k: int) -> DataFrame:
    """The `k` latest turns of each conversation, cut per task before the shuffle."""
    newest = W.partitionBy("conversation_id").orderBy(F.desc("sequence_id"))
    return turns.withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") <= k)


def _joined(turns: DataFrame, text: str, name: str) -> DataFrame:
    return turns.groupBy("conversation_id").agg(
        F.expr(f"listagg({text}, '\\n') WITHIN GROUP (ORDER BY sequence_id)").alias(name)
    )


def short_term(turns: DataFrame, k: int = 3) -> DataFrame:
    """`stm`: the last `k` turns of each conversation, oldest first."""
    recent = _latest(turns.select("conversation_id", "sequence_id", "query", "answer"), k)
    return _joined(recent.withColumn("_text", interaction(F.col("query"), F.col("answer"))), "_text", "stm")


def long_term(turns: DataFrame) -> DataFrame:
    """`ltm`: the memory of the latest turn, empty if it has none."""
    return turns.groupBy("conversation_id").agg(
        F.coalesce(F.max_by("memory", "sequence_id"), F.lit("")).alias("ltm")
    )


def next_sequence(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conversation_id").agg((F.count("*") + 1).alias("next_sequence_id"))


def memory_tail(turns: DataFrame, n: int = 1000) -> DataFrame:
    """`memory`: the last `n` characters of all interactions of each conversation.

    An interaction has at least as many characters as its labels, so the latest
    n / labels turns always cover the tail; older ones never reach the shuffle.
    """
    shortest = len("User: \nAssistant: \n")
    turns = turns.select(
        "conversation_id", "sequence_id", interaction(F.col("query"), F.col("answer")).alias("_full")
    ).withColumn("_text", last_chars(F.col("_full"), n))
    return _joined(_latest(turns, n // shortest + 1), "_text", "memory").withColumn(
        "memory", last_chars(F.col("memory"), n)
    )


def owned(turns: DataFrame, conversations: DataFrame, user_id: int) -> DataFrame:
    """Turns of the user's own conversations."""
    mine = conversations.where(F.col("user_id") == user_id).select(F.col("id").alias("conversation_id"))
    return turns.join(mine, "conversation_id", "left_semi")


def access_status(requests: DataFrame, conversations: DataFrame) -> DataFrame:
    """`status` 200, 404 (no such conversation) or 403 (another user's) for every request."""
    owners = conversations.select(F.col("id").alias("conversation_id"), F.col("user_id").alias("owner"))
    return requests.join(owners, "conversation_id", "left").withColumn(
        "status", F.when(F.col("owner").isNull(), 404).when(F.col("owner") != F.col("user_id"), 403).otherwise(200)
    ).drop("owner")
