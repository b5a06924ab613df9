"""Exact dedup with a heavy-hitter split.

A Misra-Gries summary of the digests (Spark's mergeable frequent-item sketch, the weighted form of
it) names the texts that may be frequent.  Those are counted exactly; the ones that are frequent, at
most `1 / HEAVY_SHARE`, are broadcast with the row that stays, so their copies are settled where
they lie.  All other digests go through an ordinary shuffle, in which no digest has more than that
share of the rows.

DataFrame and SQL functions only.

Nulls and empty texts are equal texts.  A null `doc_id` is less than any other.  Each row counts as
a document: of equal texts with the same largest `doc_id` one row stays.  An empty table gives an
empty result, and columns of other names play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusengine.llm.common import ROW, col, lower_ascii, text_of
from corpusengine.session import materialize

#: A digest is frequent from this share of all rows on.
HEAVY_SHARE = 1 / 1000
#: Counters of a summary: it holds every digest whose share is above some 4 / TRACKED.
TRACKED = 8192
#: Summaries are merged in so many groups before the last merge, so that no task merges those of all tasks.
MERGES = 256


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`(ROW, doc_id, digest)` of every row, written once: a row's number is the one in that table."""
    rows = docs.select(
        F.monotonically_increasing_id().alias(ROW),
        col(doc_id).alias("doc_id"),
        F.unhex(F.sha2(lower_ascii(text_of(text)).cast("binary"), 256)).alias("digest"),
    )
    return materialize(rows, "digests")


def frequent_candidates(rows: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """`short`: 64-bit hashes of the digests that a summary of `tracked` counters holds; at most `tracked` rows."""
    summaries = (
        rows.select(F.xxhash64("digest").alias("short"), F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("part"))
        .groupBy("part")
        .agg(F.expr(f"approx_top_k_accumulate(short, {tracked})").alias("summary"))
    )
    # Grouped by a constant: an empty table has no summary to merge.
    merged = summaries.withColumn("all", F.lit(0)).groupBy("all").agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(summary, {tracked}), {tracked})").alias("top"))
    return merged.select(F.explode("top.item").alias("short"))


def _grouped(rows: DataFrame) -> DataFrame:
    # Tasks aggregate what they read, so a group is one row per task in the shuffle.
    return rows.groupBy("digest").agg(
        F.max(F.struct("doc_id", (-F.col(ROW)).alias("at"))).alias("stays"), F.count("*").alias("group_size")
    )


def frequent_groups(rows: DataFrame, share: float = HEAVY_SHARE, tracked: int = TRACKED) -> DataFrame:
    """`(digest, stays, group_size)` of the verified frequent digests; at most `1 / share` rows, written."""
    least = max(2.0, share * rows.count())
    # A candidate's exact count decides; hashes that stand for two digests are told apart here.
    candidates = frequent_candidates(rows, tracked)
    counted = _grouped(rows.join(F.broadcast(candidates), F.xxhash64("digest") == F.col("short"), "left_semi"))
    return materialize(counted.where(F.col("group_size") >= least), "frequent-digests")


def classes(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", share: float = HEAVY_SHARE, tracked: int = TRACKED
) -> DataFrame:
    """`(ROW, doc_id, keep_id, group_size, kept, text_sha256)` of every row of `docs`.

    `keep_id` is the largest `doc_id` among the rows of the same text.
    """
    rows = digests(docs, text, doc_id)
    heavy = frequent_groups(rows, share, tracked)
    settled = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    # Written, so that the join may divide a large group or broadcast the few groups there are.
    groups = materialize(_grouped(rest).where("group_size > 1"), "digest-groups")
    alone = F.struct(F.col("doc_id"), (-F.col(ROW)).alias("at"))
    joined = (
        rest.join(groups, "digest", "left")
        .withColumn("stays", F.coalesce("stays", alone))
        .withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    )
    return settled.unionByName(joined).select(
        ROW,
        "doc_id",
        F.col("stays.doc_id").alias("keep_id"),
        "group_size",
        (F.col("stays.at") == -F.col(ROW)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **limits) -> DataFrame:
    """The rows of `docs` that stay, with their columns; whole rows are written once with their numbers."""
    whole = materialize(docs.select("*", F.monotonically_increasing_id().alias(f"{ROW}_whole")), "numbered")
    slim = whole.select(col(text).alias("text"), F.struct(col(doc_id), F.col(f"{ROW}_whole")).alias("doc_id"))
    gone = classes(slim, **limits).where("NOT kept").select(F.col(f"doc_id.{ROW}_whole").alias(f"{ROW}_whole"))
    return whole.join(gone, f"{ROW}_whole", "left_anti").drop(f"{ROW}_whole")


def report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`classes` without row numbers."""
    return classes(docs, text, doc_id).drop(ROW)
