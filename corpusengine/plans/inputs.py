"""Views of the test tables in the roles the operators expect."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusengine.functions.text import fallback_keywords, strip
from corpusengine.operators.chunking import assign_ids, explode_pieces
from corpusengine.operators.hybrid import route
from corpusengine.operators.inference import embed
from corpusengine.operators.sequences import with_sequence
from corpusengine.session import materialize, spread
from corpusengine.sources.turns import interactions

# Tag sizes for pages: headings over bold lead-ins over paragraphs.
LENIENT_SIZES = {"h1": 18.0, "title": 14.0, "b": 14.0, "p": 10.0, "li": 10.0}
STRICT_SIZES = {"title": 18.0, "b": 14.0, "h1": 12.0, "p": 10.0, "li": 10.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents spread over all task slots, for operators with much work per text."""
    return spread(table(spark, sf_dir, "documents"))


def document_chunks(spark: SparkSession, sf_dir: str, even: bool = True) -> DataFrame:
    """Documents as chunks `(chunk_id, section, text)`; as they lie in their files unless `even`."""
    docs = documents(spark, sf_dir) if even else table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("section"), "text")


def section_centroids(chunks: DataFrame) -> DataFrame:
    """Mean vector of every section."""
    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    return chunks.groupBy("section").agg(vector_to_array(mean).alias("embedding"))


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document chunks with their hashed-word vectors; written once because three steps read it."""
    return materialize(embed(document_chunks(spark, sf_dir), "text").drop("error"), "embedded-chunks")


def routed_queries(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> DataFrame:
    """Benchmark items as queries with vector and the two most similar sections.

    `chunks` is read once, for the mean vectors.
    """
    queries = embed(
        table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")),
        "query",
        kind="query",
    ).drop("error")
    queries = materialize(queries, "queries")
    centroids = materialize(section_centroids(chunks), "section-centroids")
    routed = route(queries, centroids).select("query_id", "sections")
    return materialize(queries.join(routed, "query_id"), "routed-queries")


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with their label as section `(vec_id, embedding, section)`."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.concat(F.lit("label "), F.col("label").cast("string")).alias("section")
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a query that asks for its own section and the next one."""
    own, following = F.col("label"), (F.col("label") + 1) % 10
    names = [F.concat(F.lit("label "), c.cast("string")) for c in (own, following)]
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), "embedding", F.array(*names).alias("sections")
    )


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank document lines as numbered chunks, with the document's keywords."""
    docs = documents(spark, sf_dir).select(
        "doc_id", F.col("source").alias("section"), fallback_keywords(F.col("text")).alias("keywords"), "text"
    )
    lines = F.filter(F.transform(F.split("text", "\n"), strip), lambda l: l != "")
    return assign_ids(explode_pieces(docs, lines, drop="text"), ["doc_id", "index_in_para"])


def numbered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions with `sequence_id` 1..n per conversation and the answer as memory."""
    pairs = interactions(table(spark, sf_dir, "conversations"))
    return with_sequence(pairs, ["conversation_id"], ["turn"], "sequence_id").withColumn("memory", F.col("answer"))


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stage events of traces."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trace_id"),
        "event_id",
        "ts",
        F.col("event_type").alias("stage"),
        F.col("value").alias("seconds"),
        F.concat("event_type", F.lit(" "), "props").alias("line"),
    )
