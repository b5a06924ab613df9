"""Section routing, hybrid retrieval, reranking input and prompts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusengine.functions.text import normalize_section, words
from corpusengine.operators import inference
from corpusengine.operators.knn import knn
from corpusengine.operators.lexical import bm25, query_sections
from corpusengine.operators.sequences import with_dense_id
from corpusengine.session import materialize, small_side


def section_pool(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Size of every query's pool: sections asked for, sections found, chunks and characters.

    Sections are aggregated before they meet the queries; the (query, chunk) pairs of the
    pools are never listed.  Membership of a hit is `in_pool`.
    """
    per_section = chunks.groupBy("section").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")
    )
    return (
        query_sections(queries)
        .join(per_section, "section", "left")
        .groupBy("query_id")
        .agg(
            F.count("*").alias("n_sections"),
            F.count("n").alias("n_found"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"),
            F.coalesce(F.sum("chars"), F.lit(0)).alias("n_chars"),
        )
    )


def in_pool(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits whose `section` is one of the query's."""
    return hits.join(query_sections(queries), ["query_id", "section"], "left_semi")


def route(
    queries: DataFrame,
    sections: DataFrame,
    k: int = 5,
    keep: int = 2,
    threshold: float | None = None,
    answers: DataFrame | None = None,
) -> DataFrame:
    """`(query_id, candidates, sections)`: the sections most similar to each query.

    `sections`: section, embedding.  With `threshold` the candidates below it are dropped and a
    query left without any takes the first `keep` sections in alphabetical order.
    `answers` (query_id, picked) overrides the choice with a model's.
    """
    numbered = materialize(
        with_dense_id(sections.select("section", "embedding"), ["section"], "section_no"), "sections"
    )
    hits = knn(queries, numbered, k, "cosine", vec_id="section_no")
    if threshold is not None:
        hits = hits.where(F.col("score") >= threshold)
    names = small_side(numbered.select("section", "section_no"))
    named = hits.join(names, F.col("vec_id") == F.col("section_no"))
    ranked = named.groupBy("query_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "section"))), lambda x: x["section"]
        ).alias("candidates")
    )
    first = [r[0] for r in numbered.select("section").distinct().orderBy("section").limit(keep).collect()]
    routed = queries.select("query_id").join(ranked, "query_id", "left").select(
        "query_id", F.coalesce("candidates", F.array(*[F.lit(s) for s in first])).alias("candidates")
    )
    choice = F.slice("candidates", 1, keep)
    if answers is None:
        return routed.withColumn("sections", choice)
    return routed.join(answers, "query_id", "left").select(
        "query_id", "candidates", F.coalesce(F.slice("picked", 1, keep), choice).alias("sections")
    )


def route_named(
    queries: DataFrame,
    named: DataFrame,
    sections: DataFrame,
    embedder: Callable[[list], list] | None = None,
    threshold: float = 0.55,
    per_name: int = 2,
    keep: int = 2,
) -> DataFrame:
    """`(query_id, sections)`: the known sections that a model's free names stand for.

    `queries`: query_id, query; `named`: query_id, names, the model's answer; `sections`: section.  Names are
    normalised; one that is a section stands first, followed or else replaced by the `per_name` sections
    most similar to it from `threshold` on; one that is similar to none stands for the first sections of the alphabet.
    The first `keep` different ones in order of mention stay.  A query without an answer is matched by its own text.

    Every different name is embedded and matched once, however many queries mention it.
    """
    known = sections.select(normalize_section(F.col("section")).alias("section")).distinct()
    known = materialize(inference.embed(known, "section", embedder).drop("error"), "known-sections")
    numbered = materialize(with_dense_id(known, ["section"], "section_no"), "sections")
    first = [r[0] for r in numbered.orderBy("section_no").limit(per_name).select("section").collect()] or ["default"]

    answered = queries.select("query_id", "query").join(named.select("query_id", "names"), "query_id", "left")
    own = F.coalesce(F.size("names"), F.lit(0)) <= 0
    mentions = answered.select(
        "query_id",
        F.posexplode(
            F.when(own, F.array(F.coalesce("query", F.lit("")))).otherwise(F.transform("names", normalize_section))
        ).alias("pos", "name"),
    )
    mentions = materialize(mentions, "section-mentions")
    names = with_dense_id(mentions.select("name").distinct(), ["name"], "query_id", costly=True)
    names = materialize(inference.embed(names, "name", embedder).drop("error"), "section-names")
    near = knn(names, numbered, per_name, "cosine", vec_id="section_no").where(F.col("score") >= threshold)
    listed = (
        near.join(small_side(numbered.select("section", "section_no")), F.col("vec_id") == F.col("section_no"))
        .groupBy("query_id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "section"))), lambda x: x["section"]).alias("similar"))
    )
    exact = numbered.select(F.col("section").alias("name"), F.lit(True).alias("exact"))
    default = F.array(*[F.lit(s) for s in first])
    matches = (
        names.select("query_id", "name")
        .join(listed, "query_id", "left")
        .join(small_side(exact), "name", "left")
        .select(
            "name",
            F.when(F.col("exact"), F.array_distinct(F.concat(F.array("name"), F.coalesce("similar", F.array().cast("array<string>")))))
            .otherwise(F.coalesce("similar", default))
            .alias("matches"),
        )
    )
    # A name that many queries mention is a row of each of them; the few matches per name come to them.
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "matches"))), lambda x: x["matches"])
    return (
        mentions.join(small_side(materialize(matches, "name-matches")), "name")
        .groupBy("query_id")
        .agg(section_preference(F.flatten(ordered), keep).alias("sections"))
    )


def section_preference(proposed: Column, keep: int = 2) -> Column:
    """First `keep` distinct names in order of mention."""
    return F.slice(F.array_distinct(proposed), 1, keep)


def merge(vector_hits: DataFrame, lexical_hits: DataFrame) -> DataFrame:
    """Vector hits, then BM25 hits; a chunk found by both keeps its vector entry."""
    tagged = vector_hits.select(
        "query_id", "chunk_id", F.lit("vector").alias("retrieval_source"), "score", "rank", F.lit(0).alias("_src")
    ).unionByName(
        lexical_hits.select(
            "query_id", "chunk_id", F.lit("bm25").alias("retrieval_source"), "score", "rank", F.lit(1).alias("_src")
        )
    )
    seen = W.partitionBy("query_id", "chunk_id").orderBy("_src", "rank")
    place = W.partitionBy("query_id").orderBy("_src", "rank")
    return (
        tagged.withColumn("_nth", F.row_number().over(seen))
        .where("_nth = 1")
        .withColumn("position", F.row_number().over(place))
        .drop("_nth", "_src", "rank")
    )


def vector_hits(
    queries: DataFrame, chunks: DataFrame, k: int = 5, overfetch: int = 10, prefilter: bool = False
) -> DataFrame:
    """Nearest chunks inside the query's sections.

    By default the `overfetch * k` nearest chunks of the whole corpus are cut down to the pool, which may
    leave fewer than `k`; `prefilter` searches the pool itself.
    """
    if prefilter:
        near = knn(queries, chunks, k, vec_id="chunk_id", within=("sections", "section"))
        return near.select("query_id", F.col("vec_id").alias("chunk_id"), "score", "rank")
    near = knn(queries, chunks, k * overfetch, vec_id="chunk_id").withColumnRenamed("vec_id", "chunk_id")
    # Written because measuring it must not search twice.
    near = small_side(materialize(near, "near-hits"))
    placed = chunks.select("chunk_id", "section").join(near, "chunk_id")
    best = W.partitionBy("query_id").orderBy("rank")
    return (
        in_pool(placed, queries)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "chunk_id", "score", "rank")
    )


def search(
    queries: DataFrame, chunks: DataFrame, vector_k: int = 5, bm25_k: int = 5, overfetch: int = 10,
    prefilter: bool = False,
) -> DataFrame:
    """Hybrid hits `(query_id, chunk_id, retrieval_source, score, position)`.

    `queries`: query_id, query, embedding, sections; `chunks`: chunk_id, text, embedding, section.
    """
    return merge(
        vector_hits(queries, chunks, vector_k, overfetch, prefilter),
        bm25(queries, chunks, bm25_k),
    )


def unique_texts(hits: DataFrame) -> DataFrame:
    """Distinct texts of the hits and their context, per query, in first-seen order.

    `hits`: query_id, position, chunk_text, context_chunks.
    """
    texts = F.concat(
        F.array("chunk_text"),
        F.coalesce(F.transform("context_chunks", lambda c: c["chunk_text"]), F.array().cast("array<string>")),
    )
    flat = hits.select("query_id", "position", F.posexplode(texts).alias("i", "text")).where(
        "text IS NOT NULL AND text <> ''"
    )
    at = F.struct("position", "i")
    if dict(hits.dtypes)["position"] in ("tinyint", "smallint", "int"):
        # One number of fixed width, null first, so that the texts are hashed and not sorted.
        at = F.shiftleft(F.coalesce(F.col("position").cast("bigint"), F.lit(-(1 << 31) - 1)), 31) + F.col("i")
    firsts = flat.groupBy("query_id", "text").agg(F.min(at).alias("at"))
    order = W.partitionBy("query_id").orderBy("at")
    return firsts.select("query_id", "text", F.row_number().over(order).alias("text_no"))


def overlap_score(query: Column, text: Column) -> Column:
    """Share of common words: |A ∩ B| / |A ∪ B| of the lower-case word sets."""
    a, b = F.array_distinct(words(F.lower(query))), F.array_distinct(words(F.lower(text)))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def rerank(
    pairs: DataFrame, n: int = 5, scorer: Callable[[Column, Column], Column] = overlap_score,
    text_id: str = "chunk_id", decimals: int = 6,
) -> DataFrame:
    """Best `n` texts per query by `scorer(query, text)`, ties by `text_id`.

    `scorer` is any Column function; a model's Arrow function fits as well.
    """
    scored = pairs.withColumn("rerank_score", F.round(scorer(F.col("query"), F.col("text")), decimals))
    best = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), text_id)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def score_pairs(
    pairs: DataFrame,
    load_model: Callable[[], Callable[[list[str], list[str]], list[float]]],
    batch_size: int = 8,
    out: str = "rerank_score",
) -> DataFrame:
    """Adds `out`, the model's score of every (query, text); null where it fails.

    `load_model` runs once per Python worker and returns the model, which scores a batch of queries and texts.  The pairs
    of a batch that fails are scored one by one, so only those at fault get null.
    """

    def make():
        model = load_model()

        def score(queries: list[str], texts: list[str]) -> list[float]:
            scores = [float(s) for s in model(queries, texts)]
            if len(scores) != len(texts):
                raise ValueError(f"{len(scores)} scores for {len(texts)} pairs")
            return scores

        def predict(queries: np.ndarray, texts: np.ndarray) -> np.ndarray:
            q, t = [str(x) for x in queries], [str(x) for x in texts]
            try:
                return np.array(score(q, t))
            except Exception:
                if len(q) == 1:
                    return np.array([np.nan])
                return np.concatenate([predict(queries[i : i + 1], texts[i : i + 1]) for i in range(len(q))])

        return predict

    model = predict_batch_udf(make, return_type=T.DoubleType(), batch_size=batch_size)
    texts = [F.coalesce(F.col(c), F.lit("")) for c in ("query", "text")]
    return pairs.withColumn(out, F.nanvl(model(*texts), F.lit(None).cast("double")))


def rerank_model(
    pairs: DataFrame,
    load_model: Callable[[], Callable[[list[str], list[str]], list[float]]],
    n: int = 5,
    batch_size: int = 8,
    decimals: int = 6,
    text_id: str = "position",
) -> DataFrame:
    """Best `n` texts per query by the model's score, ties by `text_id`; `scored` says whether the model ranked them.

    `pairs`: query_id, query, text and `text_id`.  If any pair of a query has no score, the query's first `n` texts in
    order of `text_id` stay.
    """
    scored = materialize(score_pairs(pairs, load_model, batch_size), "pair-scores")
    scored = scored.withColumn("rerank_score", F.round("rerank_score", decimals))
    failed = scored.where("rerank_score IS NULL").select("query_id").distinct().withColumn("_failed", F.lit(True))
    marked = scored.join(small_side(failed), "query_id", "left").withColumn("scored", F.col("_failed").isNull()).drop("_failed")
    best = W.partitionBy("query_id").orderBy(F.when(F.col("scored"), -F.col("rerank_score")), text_id)
    return (
        marked.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= n)
        .withColumn("rerank_score", F.when(F.col("scored"), F.col("rerank_score")))
    )


def merged_queries(queries: DataFrame, by: str = "request_id", sep: str = " ") -> DataFrame:
    """The query variants of every request joined into one text, in id order."""
    return queries.groupBy(by).agg(
        F.expr(f"listagg(query, '{sep}') WITHIN GROUP (ORDER BY query_id)").alias("query")
    )
