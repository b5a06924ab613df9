"""Batch BM25 over per-query section pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusengine.functions.arrays import term_counts
from corpusengine.functions.text import words
from corpusengine.session import among, materialize, small_side

def query_sections(queries: DataFrame) -> DataFrame:
    """Distinct `(query_id, section)` of a query batch with a `sections` array."""
    return queries.select("query_id", F.explode(F.array_distinct("sections")).alias("section"))


def _terms(chunks: DataFrame) -> DataFrame:
    """`(chunk_id, section, len, terms)`: token count and term frequencies, computed inside the row."""
    return chunks.select("chunk_id", "section", words(F.lower("text")).alias("_tokens")).select(
        "chunk_id", "section", F.size("_tokens").alias("len"), term_counts(F.col("_tokens")).alias("terms")
    )


def section_statistics(chunks: DataFrame) -> DataFrame:
    """`(section, term, df, len)` written once; the row without term holds chunk and token counts.

    It is much smaller than the corpus and serves any number of query batches.
    """
    return _statistics(_terms(chunks))


def save_index(chunks: DataFrame, folder: str) -> None:
    """Write the lexical index: term frequencies of the chunks by section, and section statistics."""
    spark = chunks.sparkSession
    _terms(chunks).hint("rebalance", F.col("section")).write.mode("overwrite").partitionBy("section").parquet(f"{folder}/terms")
    _counts(_stored_terms(spark, folder)).write.mode("overwrite").parquet(f"{folder}/statistics")


def load_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The stored `(terms, stats)` for `bm25`, which then reads the asked sections only."""
    return _stored_terms(spark, folder), spark.read.parquet(f"{folder}/statistics")


def _stored_terms(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.read.parquet(f"{folder}/terms").schema
    named = [T.StructField("section", T.StringType()) if f.name == "section" else f for f in found]
    return spark.read.schema(T.StructType(named)).parquet(f"{folder}/terms")


def _statistics(terms: DataFrame) -> DataFrame:
    return materialize(_counts(terms), "section-terms")


def _counts(terms: DataFrame) -> DataFrame:
    rows = terms.select(
        "section",
        "len",
        # The outer form keeps the optimizer from evaluating the term counts once more as a filter.
        F.explode_outer(
            F.concat(F.array(F.lit(None).cast("string")), F.transform("terms", lambda x: x["term"]))
        ).alias("term"),
    )
    return rows.groupBy("section", "term").agg(
        F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("len"))).alias("len")
    )

def _term_weights(queries: DataFrame, stats: DataFrame, eps: float) -> DataFrame:
    """`(query_id, section, term, w, avgdl)`: idf of the query's pool times the term's count in the query."""
    pooled = queries.select("query_id", "query", F.array_sort(F.array_distinct("sections")).alias("sections"))
    # Queries with the same sections share one pool, named by its smallest query id.
    named = pooled.groupBy("sections").agg(F.min("query_id").alias("pool"))
    members = small_side(named.select("pool", F.explode("sections").alias("section")))
    pool_size = (
        stats.where("term IS NULL")
        .join(members, "section")
        .groupBy("pool")
        .agg(F.sum("df").alias("n"), (F.sum("len") / F.sum("df")).alias("avgdl"))
    )
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = stats.where("term IS NOT NULL").select("section", "term", "df")
    # The idf depends on the document frequency alone, so its mean is taken over their histogram.  Most terms are rare and
    # alike in their frequencies by section: they become one row before they meet the pools, of which there may be many.
    # A profile has an entry per asked section at most.
    profiles = materialize(
        terms.join(small_side(members.select("section").distinct()), "section", "left_semi")
        .groupBy("term")
        .agg(F.sort_array(F.collect_list(F.struct("section", "df"))).alias("profile"))
        .groupBy("profile")
        .agg(F.count("*").alias("n_terms")),
        "term-profiles",
    )
    histogram = (
        profiles.select(F.monotonically_increasing_id().alias("_no"), "n_terms", "profile")
        # Dealt out before they are unfolded, the rows of a profile are added up where they are.
        .repartition("_no")
        .select("_no", "n_terms", F.explode("profile").alias("_p"))
        .select("_no", "n_terms", F.col("_p.section").alias("section"), F.col("_p.df").alias("df"))
        .join(members, "section")
        .groupBy("_no", "n_terms", "pool")
        .agg(F.sum("df").alias("df"))
        .groupBy("pool", "df")
        .agg(F.sum("n_terms").alias("n_terms"))
    )
    floors = (
        histogram.join(pool_size, "pool")
        .groupBy("pool", "n", "avgdl")
        .agg((F.lit(eps) * F.sum(F.col("n_terms") * idf) / F.sum("n_terms")).alias("floor"))
    )
    asked = (
        pooled.join(named.select("sections", "pool"), "sections")
        .select("query_id", "pool", "sections", F.explode(words(F.lower("query"))).alias("term"))
        .groupBy("query_id", "pool", "sections", "term")
        .agg(F.count("*").alias("qtf"))
    )
    found = (
        terms.join(small_side(asked.withColumn("section", F.explode("sections"))), ["section", "term"])
        .groupBy("query_id", "pool", "sections", "term", "qtf")
        .agg(F.sum("df").alias("df"))
    )
    weight = F.col("qtf") * F.when(idf < 0, F.col("floor")).otherwise(idf)
    return found.join(floors, "pool").select(
        "query_id", F.explode("sections").alias("section"), "term", weight.alias("w"), "avgdl"
    )


def bm25(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 5,
    k1: float = 1.5,
    b: float = 0.75,
    eps: float = 0.25,
    decimals: int = 6,
    stats: DataFrame | None = None,
    terms: DataFrame | None = None,
) -> DataFrame:
    """Top-`k` chunks `(query_id, chunk_id, score, rank)` per query, positive scores only.

    `queries`: query_id, query, sections; `chunks`: chunk_id, section, text; `stats`: the
    corpus's `section_statistics` and `terms` its term frequencies, both from `load_index` or
    built here for the asked sections, which tokenises their chunks once.  Corpus statistics are those of
    the query's own pool (all chunks of its sections).  Because every chunk has one
    section, they are sums of per-section statistics, and queries with the same sections
    share them.  Scores are compared at `decimals`, ties by chunk id.

    Postings are cut down to the queries' terms and then shuffled once, by chunk.  Scoring
    and the first cut to `k` need no further shuffle, so the volume moved does not grow
    with the number of queries.
    """
    asked = query_sections(queries).where("section IS NOT NULL").select("section").distinct()
    if terms is None:
        terms = materialize(_terms(among(chunks, "section", asked)), "chunk-terms")
    else:
        terms = among(terms, "section", asked)
    stats = _statistics(terms) if stats is None else stats
    weights = materialize(_term_weights(queries, stats, eps), "term-weights")
    wanted = weights.select("section", "term").distinct()
    postings = (
        terms.select("chunk_id", "section", "len", F.explode_outer("terms").alias("t"))
        .select("chunk_id", "section", "len", F.col("t.term").alias("term"), F.col("t.tf").alias("tf"))
        .join(small_side(wanted), ["section", "term"], "left_semi")
        .repartition("chunk_id")
    )
    saturated = (
        F.col("w")
        * F.col("tf")
        * (k1 + 1)
        / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    )
    scores = (
        postings.join(small_side(weights), ["section", "term"])
        .groupBy("query_id", "chunk_id")
        .agg(F.round(F.sum(saturated), decimals).alias("score"))
        .where("score > 0")
    )
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return (
        scores.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "chunk_id", "score", "rank")
    )
