"""Approximate nearest neighbours along shifted Hilbert curves of projected vectors.

Each curve projects the vectors on a few random directions of its own, shifts them and orders
them by their place on a Hilbert curve.  The key range of a curve is cut into windows of
about equal size, and vectors are dealt to the windows.  A query meets the vectors of its window
and the two beside it on every curve; what the curves find is merged and ranked by exact distance.

Windows larger than `BLOCK` vectors are dealt over several blocks, so no task holds more
than a block and the queries that meet it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusengine.llm.common import col
from corpusengine.session import materialize

CURVES, DIRECTIONS, BITS = 24, 6, 10
#: Windows of a curve; with fewer vectors than this many of `LEAST_WINDOW`, fewer.
WINDOWS, LEAST_WINDOW = 48, 256
#: Vectors of a block, and of the sample that fits scales and window bounds.
BLOCK, SAMPLE = 8_192, 20_000
SEED = 5


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer points (rows of `cells`, coordinates below `2 ** bits`) on the Hilbert curve.

    Works from the top bit down: each level's orientation is undone by exchange and inversion,
    then the Gray code of the coordinates' bits is read off.
    """
    x = cells.astype(np.uint64).copy()
    n, dims = x.shape
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit = np.uint64(1 << level)
        low = bit - one
        for d in range(dims):
            inverted = (x[:, d] & bit) != 0
            exchange = np.where(inverted, np.uint64(0), (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(inverted, low, exchange)
            x[:, d] ^= exchange
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(n, np.uint64)
    for level in range(bits - 1, 0, -1):
        bit = np.uint64(1 << level)
        flip ^= np.where((x[:, dims - 1] & bit) != 0, bit - one, np.uint64(0))
    x ^= flip[:, None]
    key = np.zeros(n, np.uint64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << one) | ((x[:, d] >> np.uint64(level)) & one)
    return key


class Curves:
    """Projections, shifts and window bounds, fitted on a sample of vectors."""

    def __init__(self, sample: np.ndarray, windows: int):
        rng = np.random.default_rng(SEED)
        size = sample.shape[1]
        self.directions = min(DIRECTIONS, size)
        self.matrices = [np.linalg.qr(rng.normal(size=(size, self.directions)))[0] for _ in range(CURVES)]
        self.shifts = rng.uniform(0, 0.2, (CURVES, self.directions))
        self.centre = sample.mean(axis=0)
        self.scales = [np.maximum(((sample - self.centre) @ m).std(axis=0), 1e-12) for m in self.matrices]
        self.bounds = [
            np.sort(self.keys(sample, c))[[len(sample) * w // windows for w in range(1, windows)]] for c in range(CURVES)
        ]

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        spread = np.tanh(0.8 * ((vectors - self.centre) @ self.matrices[curve]) / self.scales[curve])
        cells = (0.4 * (1 + spread) + self.shifts[curve]) * (1 << BITS)
        return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1).astype(np.uint64), BITS)

    def windows(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        """A key on a bound belongs to the window above it."""
        return np.searchsorted(self.bounds[curve], self.keys(vectors, curve), side="right")


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """`(id, v)` of the rows with an id and a finite, non-zero vector of doubles."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(col(vec_id).cast("long").alias("id"), col(vector).cast("array<double>").alias("v"))
        .where(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False)))
    )


def _matrix(values) -> np.ndarray:
    return np.stack(values) if len(values) else np.empty((0, 0))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """`(query_id, rank, vec_id, score)`: for each row with `is_query` (over `id`) its `k` nearest other rows found.

    Nearness is Euclidean distance in double precision, ties to the smaller id.  Null, zero,
    non-finite vectors and rows without an id take no part, nor do vectors of another length than
    most of the sample (of equally many, the longer).  Of rows with equal id and vector
    each counts once; a query's own id is no candidate.
    """
    spark = vectors.sparkSession
    # Copies would fill windows, blocks and the places of near rows.
    rows = materialize(usable(vectors, vec_id, vector).dropDuplicates(["id", "v"]), "vectors")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    if sample.empty:
        return empty
    lengths = sample.map(len).value_counts()
    size = int(max(lengths.index, key=lambda n: (lengths[n], n)))
    rows = rows.where(F.size("v") == size)
    total = rows.count()
    windows = min(WINDOWS, max(1, total // LEAST_WINDOW))
    curves = spark.sparkContext.broadcast(Curves(_matrix([v for v in sample if len(v) == size]), windows))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                matrix = _matrix(batch["v"].to_list())
                at = {c: curves.value.windows(matrix, c) for c in range(CURVES)}
                yield pd.DataFrame({"id": batch["id"], "query": batch["query"], "v": batch["v"],
                                    "windows": list(np.stack([at[c] for c in range(CURVES)], axis=1).astype(np.int32))})

    dealt = rows.select("id", is_query.alias("query"), "v").mapInPandas(
        deal, "id long, query boolean, v array<double>, windows array<int>"
    )
    placed = materialize(dealt, "windows").select("id", "query", "v", F.posexplode("windows").alias("curve", "window"))
    # Rows of this table: curves times windows.
    sizes = placed.groupBy("curve", "window").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = F.broadcast(spark.createDataFrame(sizes.collect(), "curve int, window int, blocks int"))
    members = placed.join(sizes, ["curve", "window"]).select(
        "curve", "window", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "v"
    )
    asked = (
        placed.where("query")
        .select("id", "v", "curve", F.explode(F.array(*[F.col("window") + i for i in (-1, 0, 1)])).alias("window"))
        .join(sizes, ["curve", "window"])
        .select("curve", "window", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v")
        .toDF("q_curve", "q_window", "q_block", "q_id", "q_v")
    )

    def compare(key, own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(own) and len(queries):
            matrix, ids = _matrix(own["v"].to_list()), own["id"].to_numpy()
            step = max(1, 4_000_000 // len(ids))
            squares = np.einsum("ij,ij->i", matrix, matrix)
            # An id with several vectors takes one of the `k` places.
            by_id = np.argsort(ids, kind="stable")
            first = np.unique(ids[by_id], return_index=True)[1]
            places = min(k, len(first)) - 1
            for i in range(0, len(queries), step):
                part = queries.iloc[i : i + step]
                asked_for, asked_ids = _matrix(part["q_v"].to_list()), part["q_id"].to_numpy()
                rough = squares[None, :] - 2 * asked_for @ matrix.T
                rough[asked_ids[:, None] == ids[None, :]] = np.inf
                nearest_of_id = rough if len(first) == len(ids) else np.minimum.reduceat(rough[:, by_id], first, axis=1)
                cut = np.partition(nearest_of_id, places, axis=1)[:, places]
                slack = 1e-9 * (1 + np.abs(squares).max() + np.einsum("ij,ij->i", asked_for, asked_for))
                q, c = np.nonzero((rough <= (cut + slack)[:, None]) & np.isfinite(rough))
                exact = np.sqrt(((asked_for[q] - matrix[c]) ** 2).sum(axis=1))
                found = pd.DataFrame({"query_id": asked_ids[q], "vec_id": ids[c], "score": exact})
                found = found.sort_values(["query_id", "score", "vec_id"]).drop_duplicates(["query_id", "vec_id"])
                parts.append(found.groupby("query_id", sort=False).head(k))
        if not parts:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return pd.concat(parts)

    found = (
        members.groupBy("curve", "window", "block")
        .cogroup(asked.groupBy("q_curve", "q_window", "q_block"))
        .applyInPandas(compare, "query_id long, vec_id long, score double")
    )
    merged = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        merged.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
