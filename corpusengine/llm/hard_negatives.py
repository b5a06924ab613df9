"""Hard negatives for anchors by coordinate pruning in buckets of equal length (LEMP).

Components become the integers `floor(256 x)`; all scores are exact integer inner products.
Vectors are sorted by length and cut into buckets.  A bucket keeps, per coordinate, its unit vectors'
sorted values.  An anchor that needs the score `t` has a bucket with longest vector `m` pass
if `t <= |a| m`; then a unit vector within it must lie within the angle `arccos(t / |a| m)` of the anchor,
so its value on a focus coordinate, one of the anchor's largest, lies in a range known beforehand.  The
ranges are cut out of the sorted lists, the sets they hold are intersected, and what is left is
multiplied out.  Where the narrowest range holds most of the bucket, all of it is multiplied.

Both searches, for positives and for negatives, run twice: in the anchor's own bucket, whose results raise
the score that is needed, and in all others.  Anchors meet buckets in bounded cells.

Vectors that are null or hold a null, NaN or infinite component, and rows without label or id, take no part.
Rows equal in id, label and vector count once.  Rows with the anchor's id, whatever their vector, are neither its
positives nor its negatives; an id with several vectors is several anchors.  Vectors of another number of components than
the anchor's have no score.  An empty table gives no rows; other columns play no part.  Scores beyond 64 bits are
an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusengine.llm.common import col
from corpusengine.operators.sequences import with_dense_id
from corpusengine.session import materialize, small_side

SCALE = 256.0
#: A negative has between so many percent of the positive's score and all of it.
LEAST_PERCENT = 80
POSITIVES, NEGATIVES = 5, 5
#: Vectors of a bucket; anchors of a block on average.
BUCKET, BLOCK = 4_096, 2_048
#: Coordinates whose ranges are intersected, and the share of a bucket beyond which a range does not pay.
FOCUS, WHOLE = 6, 0.5
#: Anchors multiplied with a whole bucket at a time.
TILE = 256
#: Rounding of lengths and angles never costs a candidate.
SLACK = 1e-9
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_FOUND = "anchor long, slot int, vec_id long, score long"


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(SCALE) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Neither null nor with a component that is null, NaN or infinite."""
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, odd)


def bucketed(rows: DataFrame, vec_id: str, label: Column, vector: str) -> DataFrame:
    """`(vec_id, label, q, dim, length, place, bucket)`: places count from 0 by falling length, buckets are runs of places."""
    v = col(vector)
    ready = (
        rows.select(col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
        .where("vec_id IS NOT NULL AND label IS NOT NULL")
        .where(usable(F.col("v")))
        .dropDuplicates(["vec_id", "label", "v"])
        .select("vec_id", "label", quantised(F.col("v")).alias("q"))
    )
    square = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sized = ready.select("*", F.size("q").alias("dim"), F.sqrt(square).alias("length"), (-F.sqrt(square)).alias("short"))
    placed = with_dense_id(sized, ["dim", "short", "vec_id", "label", "q"], "place", costly=True).drop("short")
    return placed.withColumn("bucket", F.floor((F.col("place") - 1) / BUCKET).cast("long"))


# --- one cell -------------------------------------------------------------------------------------


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """The list column as a matrix of integers."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
    return flat.astype(np.int64)


class Bucket:
    """Vectors of about the same length with their coordinates' sorted lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray):
        self.ids, self.labels, self.q = ids, labels, q
        floats = q.astype(np.float64)
        lengths = np.sqrt((floats * floats).sum(1))
        self.longest = lengths.max(initial=0.0)
        self.largest = np.abs(floats).max(initial=0.0)
        self.floats = floats
        self.unit = floats / np.where(lengths > 0, lengths, 1.0)[:, None]
        # A vector shorter than the longest needs a larger cosine, so the bucket's bound holds for it too.
        self.order = np.argsort(self.unit, axis=0)
        self.sorted = np.take_along_axis(self.unit, self.order, axis=0)

    def exact(self, q: np.ndarray) -> bool:
        return float(np.abs(q).max(initial=0)) * self.largest * max(1, q.shape[-1]) < 2.0**53

    def scores(self, q: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Exact inner products of one anchor, or of several, with `rows`."""
        if self.exact(q):
            return (q.astype(np.float64) @ self.floats[rows].T).astype(np.int64)
        return q.astype(object) @ self.q[rows].astype(object).T

    def candidates(self, q: np.ndarray, needed: int) -> np.ndarray | None:
        """Rows that may score `needed` with the anchor; None for all of them."""
        floats = q.astype(np.float64)
        length = np.sqrt(floats @ floats)
        if needed <= 0:
            return None
        if length * self.longest == 0.0 or needed > length * self.longest * (1 + SLACK):
            return np.empty(0, np.int64)
        reach = np.arccos(min(1.0, needed / (length * self.longest) * (1 - SLACK)))
        unit = floats / length
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        angle = np.arccos(np.clip(unit[focus], -1.0, 1.0))
        low = np.cos(np.minimum(np.pi, angle + reach)) - SLACK
        high = np.cos(np.maximum(0.0, angle - reach)) + SLACK
        spans = [
            (np.searchsorted(self.sorted[:, f], lo, "left"), np.searchsorted(self.sorted[:, f], hi, "right"))
            for f, lo, hi in zip(focus, low, high, strict=True)
        ]
        least = min(range(len(focus)), key=lambda i: spans[i][1] - spans[i][0])
        start, stop = spans[least]
        if stop - start > WHOLE * len(self.ids):
            return None
        rows = self.order[start:stop, focus[least]]
        for f, lo, hi in zip(focus, low, high, strict=True):
            rows = rows[(self.unit[rows, f] >= lo) & (self.unit[rows, f] <= hi)]
        return rows


def _best(scores: np.ndarray, ids: np.ndarray, low: int, high: int, k: int) -> Iterator[tuple[int, int]]:
    """The first `k` `(id, score)` with scores in the window, higher scores first, ties by id."""
    at = np.flatnonzero((scores >= low) & (scores <= high))
    if len(at) > 4 * k:
        kth = -np.partition(-scores[at], k - 1)[k - 1]
        at = at[scores[at] >= kth]
    for i in sorted(at.tolist(), key=lambda i: (-scores[i], ids[i]))[:k]:
        yield int(ids[i]), int(scores[i])


def search(anchors: pa.Table, rows: pa.Table, k: int, same: bool) -> pa.Table:
    """`_FOUND` of one cell: per anchor and window of `lows` and `highs`, its first `k` rows of the same, or of another, label."""
    out: list[tuple[int, int, int, int]] = []
    for dim in set(anchors["dim"].to_pylist()) & set(rows["dim"].to_pylist()):
        mine = anchors.filter(pc.equal(anchors["dim"], dim))
        theirs = rows.filter(pc.equal(rows["dim"], dim))
        bucket = Bucket(theirs["vec_id"].to_numpy(), theirs["label"].to_numpy(), _matrix(theirs["q"], dim))
        q, ids, labels = _matrix(mine["q"], dim), mine["vec_id"].to_numpy(), mine["label"].to_numpy()
        places, lows, highs = mine["place"].to_numpy(), mine["lows"].to_pylist(), mine["highs"].to_pylist()

        def keep(i: int, at: np.ndarray, scores: np.ndarray) -> None:
            fits = ((bucket.labels[at] == labels[i]) == same) & (bucket.ids[at] != ids[i])
            at, scores = at[fits], scores[fits]
            for slot, (low, high) in enumerate(zip(lows[i], highs[i], strict=True)):
                out.extend((int(places[i]), slot, *hit) for hit in _best(scores, bucket.ids[at], low, high, k))

        whole = []
        for i in range(len(ids)):
            if not lows[i]:
                continue
            at = bucket.candidates(q[i], min(lows[i]))
            if at is None:
                whole.append(i)
            elif len(at):
                keep(i, at, bucket.scores(q[i], at))
        everything = np.arange(len(bucket.ids))
        for at in range(0, len(whole), TILE):
            some = whole[at : at + TILE]
            for i, scores in zip(some, bucket.scores(q[some]), strict=True):
                keep(i, everything, scores)
    columns = [pa.array([r[c] for r in out], pa.int32() if c == 1 else pa.int64()) for c in range(4)]
    return pa.table(columns, names=["anchor", "slot", "vec_id", "score"])


# --- searches -------------------------------------------------------------------------------------


def _meet(anchors: DataFrame, rows: DataFrame, on: list[str], k: int, same: bool) -> DataFrame:
    return anchors.groupBy(*on).cogroup(rows.groupBy(*on)).applyInArrow(lambda a, r: search(a, r, k, same), _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def windows_search(anchors: DataFrame, rows: DataFrame, n_anchors: int, k: int, same: bool) -> DataFrame:
    """`_FOUND` with `rank`: per anchor and window its first `k` rows over all buckets.

    `anchors` are rows of `bucketed` with the windows `lows` and `highs`, in scores, ends included.
    """
    own = materialize(_meet(anchors, rows, ["bucket"], k, same), "own-bucket")
    kth = _first(own, k).groupBy("anchor", "slot").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
    # A window that is full already needs no score below its last one.
    full = kth.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "kth"))).alias("full"))
    raised = anchors.join(full, F.col("place") == F.col("anchor"), "left").drop("anchor")
    raised = raised.withColumn("lows", F.transform("lows", lambda low, i: F.greatest(low, F.coalesce(F.col("full")[i], low)))).drop("full")

    buckets = rows.groupBy("bucket", "dim").agg(F.max("length").alias("longest"))
    spans = buckets.groupBy("dim").agg(F.min("bucket").alias("from"), F.max("bucket").alias("to"))
    blocks = max(1, -(-n_anchors // BLOCK))
    cells = (
        raised.where(F.size("lows") > 0)
        .join(small_side(spans), "dim")
        .withColumnRenamed("bucket", "own")
        .withColumn("bucket", F.explode(F.sequence("from", "to")))
        .where("bucket <> own")
        .join(small_side(buckets), ["bucket", "dim"])
        .where(F.array_min("lows") <= F.col("length") * F.col("longest") * (1 + SLACK))
        .withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks)))
        .select("block", "bucket", "place", "vec_id", "label", "q", "dim", "lows", "highs")
    )
    cells = materialize(cells, "anchor-cells")
    wanted = materialize(cells.select("bucket", "block").distinct(), "cells")
    others = _meet(cells, rows.join(small_side(wanted), "bucket"), ["bucket", "block"], k, same)
    return _first(own.unionByName(others), k)


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    vec_id: str = "vec_id",
    label: Column | None = None,
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
) -> DataFrame:
    """`(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`.

    `anchors` is a condition on `vec_id`.  Its first `positives` other rows of the same label are an anchor's positives;
    for each, the first `negatives` rows of other labels with at least `least_percent` of its score and at most all of it.
    """
    placed = bucketed(rows, vec_id, col("label") if label is None else label, vector)
    chosen = materialize(placed.where(anchors), "anchors")
    n_anchors = chosen.count()
    whole = chosen.withColumn("lows", F.array(F.lit(_LOW).cast("long"))).withColumn("highs", F.array(F.lit(_HIGH).cast("long")))
    near = materialize(windows_search(whole, placed, n_anchors, positives, True), "positives")

    by_rank = F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score")))
    # Below zero the window is empty: eighty percent are more than all of it.
    pairs = near.where("score >= 0").groupBy("anchor").agg(by_rank.alias("pairs"))
    asked = chosen.join(pairs, F.col("place") == F.col("anchor")).drop("anchor")
    asked = materialize(
        asked.withColumn("highs", F.transform("pairs", lambda p: p["score"])).withColumn(
            "lows",
            F.transform("pairs", lambda p: F.ceil(p["score"].cast("decimal(20,0)") * least_percent / 100).cast("long")),
        ),
        "asked",
    )
    found = windows_search(asked.drop("pairs"), placed, n_anchors, negatives, False)
    named = asked.select(F.col("place").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.posexplode("pairs").alias("slot", "pair"))
    return (
        found.withColumnRenamed("vec_id", "negative_id")
        .join(named, ["anchor", "slot"])
        .select(
            "anchor_id",
            F.col("pair.vec_id").alias("positive_id"),
            "rank",
            "negative_id",
            F.col("pair.score").alias("positive_score"),
            F.col("score").alias("negative_score"),
        )
    )
