"""Batch answering: pending questions with memory, retrieval, prompt, generation, new turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusengine.functions.text import head, normalize, tail
from corpusengine.operators import inference, memory
from corpusengine.operators.knn import knn
from corpusengine.operators.prompts import enriched_query
from corpusengine.session import materialize
from corpusengine.sources.turns import with_error_answer

# Fixed value: headings and order of what the generator reads.
GENERATION_INPUT = "Context:\n%s\n\nConversation memory:\n%s\n\nRecent turns:\n%s\n\nQuery:\n%s"


def answer_batch(
    requests: DataFrame,
    history: DataFrame,
    chunks: DataFrame,
    generate: inference.ModelFn,
    embedder: inference.ModelFn | None = None,
    k: int = 5,
    max_context: int = 4000,
    max_memory: int = 1000,
    **model_options,
) -> DataFrame:
    """One new turn per request (request_id, trace_id, conversation_id, user_id, query), one per conversation.

    A request whose generation failed is kept with the fixed error answer.
    """
    mine = history.join(requests.select("conversation_id"), "conversation_id", "left_semi")
    recalled = (
        requests.join(memory.short_term(mine), "conversation_id", "left")
        .join(memory.long_term(mine), "conversation_id", "left")
        .join(memory.next_sequence(mine), "conversation_id", "left")
        .select(
            *requests.columns,
            F.coalesce("stm", F.lit("")).alias("stm"),
            F.coalesce("ltm", F.lit("")).alias("ltm"),
            F.coalesce("next_sequence_id", F.lit(1)).alias("sequence_id"),
            normalize(F.col("query")).alias("normal"),
        )
    )
    asked = inference.embed(
        recalled.withColumn("_enriched", enriched_query(F.col("ltm"), F.col("stm"), F.col("normal"))),
        "_enriched", embedder, kind="query",
    ).drop("error", "_enriched")
    asked = materialize(asked, "requests")
    hits = knn(asked, chunks, k, query_id="request_id", vec_id="id").withColumnRenamed("query_id", "request_id")
    found = (
        hits.join(chunks.select(F.col("id").alias("vec_id"), "chunk_text"), "vec_id")
        .groupBy("request_id")
        .agg(F.expr("listagg(chunk_text, '\\n') WITHIN GROUP (ORDER BY rank)").alias("retrieved"))
    )
    prompted = asked.join(found, "request_id", "left").withColumn(
        "retrieved_chunks", head(F.coalesce("retrieved", F.lit("")), max_context)
    ).withColumn(
        "_prompt", F.format_string(GENERATION_INPUT, "retrieved_chunks", "ltm", "stm", "normal")
    )
    answered = inference.complete(prompted, "_prompt", generate, **model_options)
    said = memory.interaction(F.col("query"), F.col("answer"))
    carried = F.when(F.col("ltm") == "", said).otherwise(F.concat_ws("\n", "ltm", said))
    turns = answered.withColumn("memory", F.when(F.col("answer").isNotNull(), tail(carried, max_memory)))
    return with_error_answer(turns).select(
        "trace_id", "conversation_id", "user_id", "sequence_id", "query", "answer", "retrieved_chunks", "memory"
    )
