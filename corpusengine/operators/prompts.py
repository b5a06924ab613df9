"""Prompt texts from hits, queries and memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts used when a part of the prompt is empty.
NO_PRIMARY = "No direct data."
NO_CONTEXT = "No extra context."

ANSWER_PROMPT = (
    "Primary data:\n%s\n\nBackground:\n%s\n\nMemory:\n- LTM: %s\n- STM: %s\n\nQuestion:\n%s"
)


def tagged_text(source: Column, text: Column) -> Column:
    return F.concat(F.lit("["), F.upper(F.coalesce(source, F.lit("unknown"))), F.lit("] "), text)


def prompt_parts(hits: DataFrame) -> DataFrame:
    """`primary_text` and `context_text` per query from hits (query_id, position, retrieval_source, text)."""
    is_context = F.contains(F.lower(F.coalesce("retrieval_source", F.lit("unknown"))), F.lit("context"))
    lines = hits.select(
        "query_id",
        "position",
        F.when(~is_context, tagged_text(F.col("retrieval_source"), F.col("text"))).alias("primary_line"),
        F.when(is_context, tagged_text(F.col("retrieval_source"), F.col("text"))).alias("context_line"),
    )
    listed = "listagg({0}, '\\n') WITHIN GROUP (ORDER BY position)"
    return lines.groupBy("query_id").agg(
        F.coalesce(F.expr(listed.format("primary_line")), F.lit(NO_PRIMARY)).alias("primary_text"),
        F.coalesce(F.expr(listed.format("context_line")), F.lit(NO_CONTEXT)).alias("context_text"),
    )


def answer_prompts(queries: DataFrame, parts: DataFrame, template: str = ANSWER_PROMPT) -> DataFrame:
    """`prompt` per query (query_id, query, ltm, stm); queries without hits get the default parts."""
    return queries.join(parts, "query_id", "left").select(
        "query_id",
        F.format_string(
            template,
            F.coalesce("primary_text", F.lit(NO_PRIMARY)),
            F.coalesce("context_text", F.lit(NO_CONTEXT)),
            F.coalesce("ltm", F.lit("")),
            F.coalesce("stm", F.lit("")),
            "query",
        ).alias("prompt"),
    )


def context_blocks(hits: DataFrame) -> DataFrame:
    """Numbered context blocks per query from hits (query_id, rank, section, text)."""
    block = F.format_string(
        "--- Context Block %d (Source: %s) ---\n%s",
        F.col("rank"), F.coalesce("section", F.lit("General")), F.col("text"),
    )
    return _blocks(hits, block, "context")


def doc_blocks(hits: DataFrame) -> DataFrame:
    """`[Doc i]` blocks per query from hits (query_id, rank, text)."""
    return _blocks(hits, F.format_string("[Doc %d]\n%s", F.col("rank"), F.col("text")), "docs")


def _blocks(hits: DataFrame, block: Column, name: str) -> DataFrame:
    return (
        hits.select("query_id", "rank", block.alias("_block"))
        .groupBy("query_id")
        .agg(F.expr("listagg(_block, '\\n\\n') WITHIN GROUP (ORDER BY rank)").alias(name))
    )


def enriched_query(ltm: Column, stm: Column, query: Column) -> Column:
    """The query together with both memories, as one text to embed."""
    # Fixed value: headings and order of the text.
    return F.format_string(
        "Long-term memory:\n%s\n\nRecent conversation:\n%s\n\nUser query:\n%s", ltm, stm, query
    )
