"""Batch retrieval: expand, route, search, rerank, assemble prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusengine.functions.text import parse_lines
from corpusengine.operators import hybrid, inference
from corpusengine.operators.prompts import context_blocks
from corpusengine.session import materialize


def expand(requests: DataFrame, model: inference.ModelFn, **options) -> DataFrame:
    """`(query_id, request_id, query)`: the guarded variants of every request (request_id, query)."""
    asked = inference.apply_model(requests, "query", model, "raw", **options)
    candidates = asked.select(
        F.col("request_id").alias("query_id"), "query", parse_lines(F.coalesce("raw", F.lit(""))).alias("candidates")
    )
    variants = inference.guard_expansions(candidates)
    single = variants.select(F.col("query_id").alias("request_id"), F.explode("expansions").alias("query"))
    # Numbers of their own, whatever the request ids and however many variants there are.
    return materialize(single.select(F.monotonically_increasing_id().alias("query_id"), "request_id", "query"), "variants")


def retrieve(
    queries: DataFrame, chunks: DataFrame, sections: DataFrame, embedder: inference.ModelFn | None = None,
    top_n: int = 5, threshold: float | None = None, **search_options,
) -> DataFrame:
    """Reranked hits `(request_id, chunk_id, text, section, rerank_score, rank)`.

    `queries` (query_id, request_id, query) are routed and searched one by one; the hits of a
    request's variants are pooled and scored against their joined text.
    """
    embedded = materialize(inference.embed(queries, "query", embedder, kind="query").drop("error"), "queries")
    routed = hybrid.route(embedded, sections, threshold=threshold).select("query_id", "sections")
    routed = materialize(embedded.join(routed, "query_id"), "routed-queries")
    hits = hybrid.search(routed, chunks, **search_options)
    pooled = hits.join(routed.select("query_id", "request_id"), "query_id").select("request_id", "chunk_id").distinct()
    pairs = (
        pooled.join(hybrid.merged_queries(queries), "request_id")
        .join(chunks.select("chunk_id", "text", "section"), "chunk_id")
        .withColumnRenamed("request_id", "query_id")
    )
    return hybrid.rerank(pairs, top_n).withColumnRenamed("query_id", "request_id")


def contexts(reranked: DataFrame) -> DataFrame:
    """The numbered context text of every request."""
    return context_blocks(reranked.withColumnRenamed("request_id", "query_id")).withColumnRenamed("query_id", "request_id")
