"""Conversation turns: append with the fixed error answer, lookups, message pairing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusengine.schemas import TURN

# Fixed value: the answer stored when generation failed.
ERROR_ANSWER = "An error occurred during generation."


def with_error_answer(turns: DataFrame) -> DataFrame:
    return turns.withColumn("answer", F.coalesce("answer", F.lit(ERROR_ANSWER)))


def complete_rows(turns: DataFrame, rollups: DataFrame, at: Column) -> DataFrame:
    """Rows of the `TURN` contract: the error answer where there is none, `logs` from `trace.rollup`, `created_at`.

    A turn without log lines has an empty list.  The parts of a trace become one list here, because it is one
    cell of the row; their number is that of one request's lines.  Columns a turn lacks are null.
    """
    logs = rollups.groupBy(F.col("trace_id").cast("string").alias("trace_id")).agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "lines"))), lambda x: x["lines"])).alias("logs")
    )
    joined = with_error_answer(turns).withColumn("trace_id", F.col("trace_id").cast("string")).drop("logs").join(logs, "trace_id", "left")
    whole = joined.withColumn("logs", F.coalesce("logs", F.array().cast("array<string>"))).withColumn("created_at", at)
    have = set(whole.columns)
    return whole.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in T.StructType.fromDDL(TURN)
        ]
    )


def append_batch(rows: DataFrame, path: str, batch: int | str) -> None:
    """Write the rows of one batch in a folder of their own.

    A batch that is sent again, after a crash or by a restarted stream, takes the place of its first try.
    """
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def sink(path: str) -> Callable[[DataFrame, int], None]:
    """The function for `writeStream.foreachBatch` that appends complete rows."""
    return lambda rows, batch: append_batch(rows, path, batch)


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """All rows appended so far, each once."""
    return spark.read.schema(f"{TURN}, batch STRING").option("basePath", path).parquet(path).drop("batch")


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    """Rows with `key` = `value`; pushed down to the scan."""
    return table.where(F.col(key) == F.lit(value))


def interactions(messages: DataFrame) -> DataFrame:
    """User messages with the assistant message that follows directly, numbered per conversation.

    The pairing is an equi-join on (conversation, turn + 1), so no conversation is gathered
    in one task.
    """
    users = messages.where("role = 'user'").select(
        F.col("conv_id").alias("conversation_id"), "turn", F.col("text").alias("query")
    )
    replies = messages.where("role = 'assistant'").select(
        F.col("conv_id").alias("conversation_id"),
        (F.col("turn") - 1).alias("turn"),
        F.col("text").alias("answer"),
    )
    return users.join(replies, ["conversation_id", "turn"], "left")
