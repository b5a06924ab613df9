"""BM25 over inverted lists with block maxima.

Chunks of a section are dealt to blocks of similar length.  A block has one row per term: the chunks that
hold it, with term frequencies and lengths, and the largest frequency and least length among them,
which bound what the term can add to any score in the block.  A search sums these bounds per query and
block, scores the best blocks first, and then only those whose bound reaches the k-th score found.
Inside a block scores are added up in arrays, so (query, chunk) pairs are never rows; at most `k` hits of a
query leave a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusengine.functions.arrow import token_count
from corpusengine.operators import lexical
from corpusengine.session import among, materialize, small_side

#: Chunks of a block on average; parts that the terms of a stored section are dealt to.
BLOCK, TERM_BUCKETS = 2048, 16
#: Tokens of a block for each of its chunks, and tokens of a slice, on average and at most.
BLOCK_TOKENS, SLICE_TOKENS = 512, 2 << 20
#: Tokens that a task holds as Python objects at once, a text more or less.
HELD_TOKENS = 100_000
#: Lists that a task hands on at once.
BATCH_LISTS = 10_000
#: Blocks of a query in the first round.
FIRST = 2
_BLOCK_LISTS = (
    "section STRING, block STRING, term STRING, ids ARRAY<BIGINT>, tfs ARRAY<INT>, lens ARRAY<INT>, max_tf INT, min_len INT"
)
_LISTS = (
    "term STRING, block STRING, ids ARRAY<BIGINT>, tfs ARRAY<INT>, lens ARRAY<INT>, max_tf INT, min_len INT, "
    "section STRING, term_bucket INT"
)
_STATISTICS = "section STRING, term STRING, df BIGINT, len BIGINT"
_HITS = "query_id BIGINT, chunk_id BIGINT, score DOUBLE"


def _measured(chunks: DataFrame) -> DataFrame:
    """`(chunk_id, section, text, len, band)`: lower-case texts, their token counts and bands of these (powers of two)."""
    counted = chunks.select(
        F.col("chunk_id").cast("bigint").alias("chunk_id"), "section", F.lower("text").alias("text"), token_count(F.col("text")).alias("len")
    )
    return counted.withColumn("band", F.when(F.col("len") > 0, F.floor(F.log2("len"))).otherwise(-1).cast("bigint"))


def _invert(chunks: pa.Table) -> pa.Table:
    """The lists of one block, a row per term."""
    parts: list[pa.Array] = []
    tokens: list[str] = []
    lens = np.zeros(chunks.num_rows, dtype=np.int32)
    for row, text in enumerate(chunks["text"]):
        found = (text.as_py() or "").split()
        tokens += found
        lens[row] = len(found)
        if len(tokens) >= HELD_TOKENS or row == chunks.num_rows - 1:
            parts.append(pa.array(tokens, pa.string()).dictionary_encode())
            tokens = []
    coded = pa.chunked_array(parts).unify_dictionaries().combine_chunks()
    codes = coded.indices.to_numpy().astype(np.int64)
    pairs, tfs = np.unique(codes * chunks.num_rows + np.repeat(np.arange(chunks.num_rows), lens), return_counts=True)
    code, row = np.divmod(pairs, chunks.num_rows)
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    tfs, held = tfs.astype(np.int32), lens[row]
    offsets = pa.array(np.append(starts, len(pairs)).astype(np.int32))
    columns = {
        "section": pa.repeat(chunks["section"][0], len(starts)),
        "block": pa.repeat(chunks["block"][0], len(starts)),
        "term": coded.dictionary,
        "ids": pa.ListArray.from_arrays(offsets, chunks["chunk_id"].combine_chunks().take(pa.array(row))),
        "tfs": pa.ListArray.from_arrays(offsets, pa.array(tfs)),
        "lens": pa.ListArray.from_arrays(offsets, pa.array(held)),
        "max_tf": pa.array(np.maximum.reduceat(tfs, starts) if len(starts) else tfs),
        "min_len": pa.array(np.minimum.reduceat(held, starts) if len(starts) else held),
    }
    lists = pa.table(columns)
    # As many batches, so that Spark takes in few lists at once.
    return pa.concat_tables([lists.slice(at, BATCH_LISTS) for at in range(0, max(len(starts), 1), BATCH_LISTS)])


def inverted_lists(measured: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """`(section, block, term, ids, tfs, lens, max_tf, min_len)` of the `_measured` chunks.

    A block is a band of lengths of a section, or a part of one with more than `block` chunks or `BLOCK_TOKENS` tokens for each
    of them; `sizes` has chunks and tokens by section and band.  Texts move once, as they are, to the slice of their section that
    has their block, and a block's lists are made where it is: postings are never rows, and are not moved.
    """
    slices = sizes.groupBy("section").agg(F.greatest(F.ceil(F.sum("len") / SLICE_TOKENS), F.lit(1)).alias("slices"))
    parts = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("len") / (block * BLOCK_TOKENS)))
    dealt = sizes.join(slices, "section").select("section", "band", parts.alias("parts"), "slices")
    # Every chunk finds its band; an inner join would have the optimizer count the tokens once more as a filter.
    placed = measured.where("section IS NOT NULL").join(small_side(dealt), ["section", "band"], "left")
    placed = placed.withColumn("block", F.concat_ws("/", "band", F.pmod(F.xxhash64("chunk_id"), "parts")))
    moved = placed.select("section", F.pmod(F.xxhash64("block"), "slices").alias("slice"), "block", "chunk_id", "text")
    # Lists are many times larger than the texts by whose bytes Spark would merge partitions.
    total = sizes.agg(F.sum("len")).first()[0] or 0
    tasks = max(moved.sparkSession.sparkContext.defaultParallelism, -(-2 * total // SLICE_TOKENS))
    return moved.repartition(tasks, "section", "slice").groupBy("section", "slice", "block").applyInArrow(_invert, _BLOCK_LISTS)


def _term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def save(chunks: DataFrame, folder: str, block: int = BLOCK) -> None:
    """Write the lists by section and term bucket, and the section statistics.

    `chunks` is read twice, the first time for lengths: give a table, or columns made from one inside the row.
    """
    measured = _measured(chunks)
    sizes = materialize(
        measured.groupBy("section", "band").agg(F.count("*").alias("n"), F.sum("len").cast("bigint").alias("len")), "section-sizes"
    )
    lists = inverted_lists(measured, sizes, block).withColumn("term_bucket", _term_bucket(F.col("term")))
    # A slice of a section is in one task, so that tasks open few files.
    lists.sortWithinPartitions("section", "term_bucket", "term").write.mode("overwrite").partitionBy("section", "term_bucket").parquet(
        f"{folder}/lists"
    )
    # A term's chunks are counted in its lists; the postings are not moved for it.
    written = chunks.sparkSession.read.schema(_LISTS).parquet(f"{folder}/lists")
    counts = written.groupBy("section", "term").agg(F.sum(F.size("tfs")).cast("bigint").alias("df"))
    totals = sizes.groupBy("section").agg(F.sum("n").alias("df"), F.sum("len").alias("len"))
    statistics = counts.select("section", "term", "df", F.lit(None).cast("bigint").alias("len")).unionByName(
        totals.select("section", F.lit(None).cast("string").alias("term"), "df", "len")
    )
    statistics.write.mode("overwrite").parquet(f"{folder}/statistics")


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """The stored `(lists, stats)` for `bm25`, or None if nothing is stored."""
    try:
        return spark.read.schema(_LISTS).parquet(f"{folder}/lists"), spark.read.schema(_STATISTICS).parquet(f"{folder}/statistics")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _impact(tf, length, avgdl, k1: float, b: float):
    """What a term of weight 1 adds; grows with `tf`, falls with `length`."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))


def _score_block(asked: pa.Table, lists: pa.Table, k: int, k1: float, b: float, decimals: int) -> pa.Table:
    """The first `k` hits of every query of one block."""
    rows = {term: i for i, term in enumerate(lists["term"].to_pylist())}
    ids, tfs, lens = (lists[c].combine_chunks() if lists.num_rows else None for c in ("ids", "tfs", "lens"))
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    if rows and asked.num_rows:
        starts = ids.offsets.to_numpy()
        chunk_ids, at = np.unique(ids.flatten().to_numpy(), return_inverse=True)
        tf = tfs.flatten().to_numpy().astype(np.float64)
        length = lens.flatten().to_numpy().astype(np.float64)
        base = starts[0]
        by_query: dict[int, list[tuple[str, float, float]]] = {}
        for q, term, w, avgdl in zip(*(asked[c].to_pylist() for c in ("query_id", "term", "w", "avgdl")), strict=True):
            by_query.setdefault(q, []).append((term, w, avgdl))
        for q, wanted in by_query.items():
            score = np.zeros(len(chunk_ids))
            for term, w, avgdl in sorted(wanted):
                if (i := rows.get(term)) is not None:
                    span = slice(starts[i] - base, starts[i + 1] - base)
                    score[at[span]] += w * _impact(tf[span], length[span], avgdl, k1, b)
            score = np.round(score, decimals)
            hits = np.flatnonzero(score > 0)
            if len(hits) > k:
                hits = hits[score[hits] >= np.partition(score[hits], len(hits) - k)[len(hits) - k]]
                hits = hits[np.lexsort((chunk_ids[hits], -score[hits]))[:k]]
            out.append((chunk_ids[hits], score[hits], q))
    columns = [
        np.concatenate([np.full(len(c), q, np.int64) for c, _, q in out]) if out else np.empty(0, np.int64),
        np.concatenate([c for c, _, _ in out]) if out else np.empty(0, np.int64),
        np.concatenate([s for _, s, _ in out]) if out else np.empty(0),
    ]
    return pa.table(columns, names=["query_id", "chunk_id", "score"])


def bm25(
    queries: DataFrame,
    lists: DataFrame,
    stats: DataFrame,
    k: int = 5,
    k1: float = 1.5,
    b: float = 0.75,
    eps: float = 0.25,
    decimals: int = 6,
    first: int = FIRST,
) -> DataFrame:
    """Top-`k` chunks `(query_id, chunk_id, score, rank)` of every query, as `lexical.bm25` gives them.

    `lists` and `stats` come from `load`.  Statistics are those of the query's own pool, so the bounds, which depend on
    its mean length, are worked out per query from a list's largest frequency and least length.
    """
    asked = lexical.query_sections(queries).where("section IS NOT NULL").select("section").distinct()
    weights = materialize(lexical._term_weights(queries, stats, eps), "term-weights")
    wanted = weights.select("section", "term").distinct().withColumn("term_bucket", _term_bucket(F.col("term")))
    keys = ["section", "term", "term_bucket"] if "term_bucket" in lists.columns else ["section", "term"]
    held = among(lists, "section", asked).join(small_side(wanted.select(keys)), keys, "left_semi")
    held = materialize(held.select("section", "block", "term", "ids", "tfs", "lens", "max_tf", "min_len"), "asked-lists")

    most = F.greatest("w", F.lit(0.0)) * _impact(F.col("max_tf"), F.col("min_len"), F.col("avgdl"), k1, b)
    bounds = (
        held.select("section", "block", "term", "max_tf", "min_len")
        .join(small_side(weights), ["section", "term"])
        .groupBy("query_id", "section", "block")
        .agg(F.sum(most).alias("bound"))
        .where("bound > 0")
    )
    by_bound = W.partitionBy("query_id").orderBy(F.desc("bound"), "section", "block")
    bounds = materialize(bounds.withColumn("turn", F.row_number().over(by_bound)), "block-bounds")

    def scored(pairs: DataFrame) -> DataFrame:
        terms = pairs.select("query_id", "section", "block").join(small_side(weights), ["query_id", "section"])
        blocks = small_side(materialize(pairs.select("section", "block").distinct(), "blocks"))
        return (
            terms.groupBy("section", "block")
            .cogroup(held.join(blocks, ["section", "block"], "left_semi").groupBy("section", "block"))
            .applyInArrow(lambda q, l: _score_block(q, l, k, k1, b, decimals), _HITS)
        )

    near = materialize(scored(bounds.where(F.col("turn") <= first)), "first-hits")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    kth = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    left = bounds.where(F.col("turn") > first).join(small_side(kth), "query_id", "left")
    # Scores are rounded, and added up in another order than the bounds.
    reach = F.col("kth").isNull() | (F.col("bound") * (1 + 1e-9) + 10.0**-decimals >= F.col("kth"))
    left = materialize(left.where(reach).select("query_id", "section", "block"), "blocks-in-reach")
    return (
        near.unionByName(scored(left))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "chunk_id", "score", "rank")
    )
