"""Offline build: pages or spans to cleaned, enriched topics, chunks and the vector index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusengine.functions.text import parse_json_map
from corpusengine.operators import chunking, dedup, inference, structure
from corpusengine.session import materialize


class Pipeline:
    """Steps `DataFrame -> DataFrame` applied in the order they were added."""

    def __init__(self, *steps: Callable[[DataFrame], DataFrame]):
        self.steps = list(steps)

    def add_step(self, step: Callable[[DataFrame], DataFrame]) -> "Pipeline":
        self.steps.append(step)
        return self

    def run(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = df.transform(step)
        return df


def clean_topics(topics: DataFrame, near: bool = True) -> DataFrame:
    """Topics whose text survives the guard; repeats are removed across all of them."""
    keyed = topics.withColumn("_topic", F.struct("doc_id", "topic_seq"))
    texts = keyed.select(F.col("_topic").alias("doc_id"), "text")
    cleaned = dedup.clean(texts, near=near).select(F.col("doc_id").alias("_topic"), F.col("text").alias("_clean"))
    return keyed.join(cleaned, "_topic").withColumn("text", F.col("_clean")).drop("_topic", "_clean")


def topics_from_spans(
    spans: DataFrame, keyword_model: inference.ModelFn | None = None, near: bool = True, **structure_options
) -> DataFrame:
    """Cleaned topics with keywords; without a model all keywords are the fallback ones.

    `keyword_model` maps JSON payloads to JSON answers `{topic key: [keywords]}`, where the
    payload's `topic_id` is `doc_id/topic_id`.
    """
    topics = materialize(clean_topics(structure.hierarchy(spans, **structure_options), near), "topics")
    key = F.concat_ws("/", "doc_id", "topic_id")
    if keyword_model is None:
        answers = topics.sparkSession.createDataFrame([], "topic_key STRING, batch_no BIGINT, keywords ARRAY<STRING>")
    else:
        keyed = topics.select("doc_id", "topic_seq", key.alias("topic_id"), "text")
        answers = keyword_answers(inference.keyword_requests(keyed), keyword_model)
    return inference.enrich(topics.withColumn("topic_key", key), answers, ["topic_key"]).drop("topic_key")


def keyword_answers(requests: DataFrame, model: inference.ModelFn, **options) -> DataFrame:
    """`(topic_key, batch_no, keywords)` from the model's answers to keyword payloads.

    An empty answer, or one that is no JSON object, is refused and the payload asked again.
    """
    answered = inference.apply_accepted(
        requests, "payload", model, inference.refuse_no_json_map, "raw", batch_size=1, **options
    )
    return answered.where("raw IS NOT NULL").select(
        "batch_no", F.explode(parse_json_map(F.col("raw"))).alias("topic_key", "keywords")
    )


def chunks_from_topics(topics: DataFrame, embedder: inference.ModelFn | None = None, **split_options) -> DataFrame:
    """Topics to the chunk table: split, numbered, scored, linked, with context and vectors."""
    chunks = chunking.build_chunks(topics, ["doc_id", "topic_seq"], ["doc_id", "section_id"], **split_options)
    embedded = inference.embed(chunks, "chunk_text", embedder)
    metadata = F.struct(
        "section_id", "section_name", "topic_id", "topic_name", "text", "keywords", "index_in_para"
    )
    return embedded.select(
        "id",
        "chunk_text",
        "embedding",
        "confidence_score",
        metadata.alias("chunk_metadata"),
        "prev_chunk_id",
        "next_chunk_id",
        F.current_timestamp().cast("timestamp_ntz").alias("created_at"),
        "context_chunks",
    )
