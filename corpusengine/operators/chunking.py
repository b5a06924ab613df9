"""Chunks: recursive splitting, ids, links, context windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusengine.functions.arrays import explode_rows
from corpusengine.functions.arrow import recursive_chunks
from corpusengine.functions.text import confidence, context_radius, is_blank
from corpusengine.operators.sequences import with_dense_id

# Separators, coarsest first.
PLAIN_SEPARATORS = ("\n\n", "\n", " ", "")
TOPIC_SEPARATORS = ("\n\n", "\n", "•", ". ", " ")


def recursive(
    df: DataFrame,
    text: str = "text",
    size: int = 800,
    overlap: int = 150,
    separators: tuple[str, ...] = PLAIN_SEPARATORS,
) -> DataFrame:
    """One row per chunk with its 1-based `index_in_para`; blank texts give none."""
    split = recursive_chunks(size, overlap, separators)
    return explode_pieces(df.where(~is_blank(F.col(text))), split(F.col(text)), drop=text)


def explode_pieces(df: DataFrame, pieces: Column, drop: str) -> DataFrame:
    keep = [c for c in df.columns if c != drop]
    return explode_rows(df, keep, pieces, "_i", "chunk_text").select(
        *keep, (F.col("_i") + 1).cast("int").alias("index_in_para"), "chunk_text"
    )


def assign_ids(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Chunk ids 1..N over the whole table, in item order then split order."""
    return with_dense_id(chunks, order, "id", costly=True)


def score(chunks: DataFrame, keywords: str = "keywords") -> DataFrame:
    return chunks.withColumn("confidence_score", confidence(F.col("chunk_text"), F.col(keywords)))


def _with_halo(chunks: DataFrame, reach: int, block: int) -> DataFrame:
    """Chunks in blocks of consecutive ids, each block with `reach` rows of its neighbours.

    Dense ids make all blocks equally large, whatever the size of a document or section.
    """
    at = F.col("id") - 1
    own = F.floor(at / block)
    blocks = F.sequence(F.floor(F.greatest(at - reach, F.lit(0)) / block), F.floor((at + reach) / block))
    return chunks.withColumn("_own", own).withColumn("_block", F.explode(blocks))


def _same(group: list[str]) -> Column:
    prev = W.partitionBy("_block").orderBy("id")
    same = F.lag("id").over(prev) == F.col("id") - 1
    for g in group:
        same = same & F.lag(g).over(prev).eqNullSafe(F.col(g))
    return F.coalesce(same, F.lit(False))


def link(chunks: DataFrame, group: list[str], block: int = 4096) -> DataFrame:
    """`prev_chunk_id` / `next_chunk_id`: the adjacent ids when they share the columns `group`."""
    window = W.partitionBy("_block").orderBy("id")
    marked = _with_halo(chunks, 1, block).withColumn("_joined", _same(group))
    linked = marked.withColumn(
        "prev_chunk_id", F.when(F.col("_joined"), F.col("id") - 1)
    ).withColumn("next_chunk_id", F.when(F.lead("_joined").over(window), F.col("id") + 1))
    return linked.where("_block = _own").drop("_block", "_own", "_joined")


def context(
    chunks: DataFrame, group: list[str], score: str = "confidence_score", max_radius: int = 3, block: int = 4096
) -> DataFrame:
    """`context_chunks`: the linked chunks within the row's radius, itself included, by id.

    The frame is the widest radius; a filter narrows it to the row's own.
    """
    window = W.partitionBy("_block").orderBy("id")
    frame = window.rowsBetween(-max_radius, max_radius)
    runs = (
        _with_halo(chunks, max_radius, block)
        .withColumn("_joined", _same(group))
        .withColumn("_run", F.sum(F.when(F.col("_joined"), 0).otherwise(1)).over(window.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_radius", context_radius(F.col(score)))
        .withColumn("_near", F.collect_list(F.struct("id", "chunk_text", "_run")).over(frame))
        .where("_block = _own")
    )
    reachable = F.filter(
        "_near",
        lambda n: (n["_run"] == F.col("_run")) & (F.abs(n["id"] - F.col("id")) <= F.col("_radius")),
    )
    return runs.withColumn(
        "context_chunks",
        F.transform(reachable, lambda n: F.struct(n["id"].alias("chunk_id"), n["chunk_text"].alias("chunk_text"))),
    ).drop("_block", "_own", "_joined", "_run", "_radius", "_near")


def build_chunks(
    topics: DataFrame,
    order: list[str],
    group: list[str],
    size: int = 100,
    overlap: int = 20,
    separators: tuple[str, ...] = TOPIC_SEPARATORS,
) -> DataFrame:
    """Topics with keywords to scored, linked chunks with their context windows."""
    pieces = recursive(topics.withColumn("_text", F.col("text")), "_text", size, overlap, separators)
    numbered = assign_ids(pieces, [*order, "index_in_para"])
    return context(link(score(numbered), group), group)
