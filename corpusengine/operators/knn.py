"""Exact batch k-nearest-neighbour search.

Vectors stay where they are: every task multiplies its blocks of vectors with the query
matrix and keeps the `k` best per query, so no (query, vector) pairs are ever emitted.
Queries beyond the broadcast bound meet the vectors in a grid of bounded blocks instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusengine.functions.text import normalize_section
from corpusengine.functions.vectors import unit
from corpusengine.session import among, materialize, small_side

#: Every Python worker has its own copy of the queries and their hits.
BROADCAST_BYTES = 16 << 20
GRID_QUERIES = 32768
GRID_VECTORS = 65536
#: Products of one step; a few tables of this size are all that a search needs beside its blocks.
TILE_QUERIES = 512
TILE_VECTORS = 2048
DECIMALS = 6
_OUT = "query_id BIGINT, vec_id BIGINT, d DOUBLE"


class _Queries:
    """Query matrix with, per search key, the rows that want this key."""

    def __init__(self, ids, matrix: np.ndarray, wanted: list | None):
        self.ids = np.asarray(ids, dtype=np.int64)
        self.matrix = matrix
        self.by_key: dict | None = None
        if wanted is not None:
            rows: dict = {}
            for row, keys in enumerate(wanted):
                for key in dict.fromkeys(keys if keys is not None else ()):
                    rows.setdefault(key, []).append(row)
            self.by_key = {k: np.asarray(v) for k, v in rows.items()}


class _Best:
    """The k smallest (distance, id) seen so far for every query."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.d = np.full((n, k), np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def meet(self, rows: np.ndarray, q: np.ndarray, v: np.ndarray, ids: np.ndarray, metric: str) -> None:
        """The queries `rows`, with vectors `q`, meet the vectors `v`.

        Products are compared with what the k-th distance so far allows, give or take the rounding; distances
        are worked out and rounded only for the few that pass.
        """
        g = q @ v.T
        qq, vv = ((q * q).sum(1), (v * v).sum(1)) if metric == "l2" else (np.zeros(len(q)), np.zeros(len(v)))
        worst = self.d[rows, -1].copy()
        unfilled = np.flatnonzero(np.isinf(worst))
        if len(unfilled) and len(v) > self.k:
            d = _rounded(qq[unfilled, None] + vv, g[unfilled], metric)
            worst[unfilled] = np.partition(d, self.k - 1, axis=1)[:, self.k - 1]
        slack = 10.0**-DECIMALS + 1e-12 * (qq + vv.max())
        least = (qq - worst - slack) / 2.0 if metric == "l2" else -worst - slack
        r, c = np.nonzero(g >= least[:, None] + vv / 2.0)
        d = _rounded(qq[r] + vv[c], g[r, c], metric)
        near = d <= worst[r]
        if near.any():
            self._add(rows, r[near], d[near], ids[c[near]])

    def _add(self, rows: np.ndarray, r: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        hit = np.unique(r)
        all_r = np.concatenate([np.repeat(hit, self.k), r])
        all_d = np.concatenate([self.d[rows[hit]].ravel(), d])
        all_i = np.concatenate([self.ids[rows[hit]].ravel(), ids])
        order = np.lexsort((all_i, all_d, all_r))
        starts = np.searchsorted(all_r[order], hit)
        take = order[(starts[:, None] + np.arange(self.k)).ravel()]
        self.d[rows[hit]] = all_d[take].reshape(-1, self.k)
        self.ids[rows[hit]] = all_i[take].reshape(-1, self.k)

    def table(self, query_ids: np.ndarray) -> pd.DataFrame:
        r, c = np.nonzero(np.isfinite(self.d))
        return pd.DataFrame({"query_id": query_ids[r], "vec_id": self.ids[r, c], "d": self.d[r, c]})


def _rounded(squares: np.ndarray, products: np.ndarray, metric: str) -> np.ndarray:
    """Distances from the sums of both squared lengths and the products."""
    if metric == "cosine":
        return np.round(-products, DECIMALS)
    return np.round(np.maximum(squares - 2.0 * products, 0.0), DECIMALS)


def _search_block(
    best: _Best, queries: _Queries, ids: np.ndarray, matrix: np.ndarray, keys, metric: str
) -> None:
    if queries.by_key is None:
        groups = [(np.arange(len(queries.ids)), slice(None))]
    else:
        codes, names = pd.factorize(pd.Series(keys))
        groups = [
            (queries.by_key[name], np.flatnonzero(codes == code))
            for code, name in enumerate(names)
            if name in queries.by_key
        ]
    for rows, cols in groups:
        part, part_ids = matrix[cols], ids[cols]
        for at in range(0, len(part), TILE_VECTORS):
            some, some_ids = part[at : at + TILE_VECTORS], part_ids[at : at + TILE_VECTORS]
            for row in range(0, len(rows), TILE_QUERIES):
                asked = rows[row : row + TILE_QUERIES]
                best.meet(asked, queries.matrix[asked], some, some_ids, metric)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError(f"vectors of {sorted(set(lengths.tolist()))} components")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _as_table(best: _Best, queries: _Queries) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_pandas(best.table(queries.ids), preserve_index=False)


def _by_broadcast(queries: DataFrame, vectors: DataFrame, k: int, metric: str, keyed: bool) -> DataFrame:
    table = queries.toArrow()
    packed = _Queries(
        table["query_id"].to_numpy(), _matrix(table["q"]), table["keys"].to_pylist() if keyed else None
    )
    shared = vectors.sparkSession.sparkContext.broadcast(packed)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = shared.value
        best = _Best(len(local.ids), k)
        for batch in batches:
            if batch.num_rows:
                keys = batch.column("key").to_pandas() if keyed else None
                ids = batch.column("vec_id").to_numpy()
                _search_block(best, local, ids, _matrix(batch.column("v")), keys, metric)
        yield from _as_table(best, local)

    return vectors.mapInArrow(search, _OUT)


def _by_grid(
    queries: DataFrame, vectors: DataFrame, n_queries: int, n_vectors: int, k: int, metric: str, keyed: bool
) -> DataFrame:
    """Every block of queries meets every block of vectors in one bounded cell.

    Both sides name a cell in the same types: an int and a bigint of one value are dealt to different partitions.
    """
    q_blocks = -(-n_queries // GRID_QUERIES)
    slots = queries.sparkSession.sparkContext.defaultParallelism
    v_blocks = max(-(-n_vectors // GRID_VECTORS), -(-2 * slots // q_blocks))
    q = queries.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).withColumn(
        "_v", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1)))
    )
    v = vectors.withColumn("_v", F.pmod(F.xxhash64("vec_id"), F.lit(v_blocks)).cast("int")).withColumn(
        "_q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    )

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        packed = _Queries(
            left["query_id"].to_numpy(), _matrix(left["q"]), left["keys"].to_pylist() if keyed else None
        )
        best = _Best(len(packed.ids), k)
        keys = right["key"].to_pandas() if keyed else None
        _search_block(best, packed, right["vec_id"].to_numpy(), _matrix(right["v"]), keys, metric)
        return pa.Table.from_pandas(best.table(packed.ids), preserve_index=False)

    return q.groupBy("_q", "_v").cogroup(v.groupBy("_q", "_v")).applyInArrow(cell, _OUT)


def knn(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    metric: str = "l2",
    query_id: str = "query_id",
    query_vec: str = "embedding",
    vec_id: str = "vec_id",
    vec: str = "embedding",
    within: tuple[str, str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The `k` nearest vectors `(query_id, vec_id, score, rank)` of every query.

    `metric` "l2" scores squared distances, nearest first; "cosine" scores similarities,
    highest first.  Scores are compared at six decimals, ties by vector id.  `within`
    = (array column of the queries, key column of the vectors) confines a query to the
    vectors whose key it names; of a table stored by that key only the named parts are read.  All queries must have the same number of components; vectors
    with another number, or with a null among them, cannot be compared and are no candidates.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"metric {metric!r}")
    ready = (lambda c: unit(F.col(c))) if metric == "cosine" else (lambda c: F.col(c).cast("array<double>"))
    q = queries.where(F.col(query_vec).isNotNull() & (F.size(query_vec) > 0)).select(
        F.col(query_id).cast("bigint").alias("query_id"),
        ready(query_vec).alias("q"),
        *([F.col(within[0]).alias("keys")] if within else []),
    )
    if within:
        named = queries.select(F.explode(within[0]).alias("key")).where("key IS NOT NULL")
        vectors = among(vectors, within[1], named.distinct())
    narrow = (lambda c: unit(F.col(c))) if metric == "cosine" else F.col
    v = vectors.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        narrow(vec).alias("v"),
        *([F.col(within[1]).alias("key")] if within else []),
    )
    size = q.agg(
        F.count("*").alias("n"),
        F.min(F.size("q")).alias("least"),
        F.max(F.size("q")).alias("most"),
        F.coalesce(F.sum(F.size("q") * 8 + (F.size("keys") * 32 if within else F.lit(0)) + 64), F.lit(0)).alias("bytes"),
    ).first()
    if size["least"] != size["most"]:
        raise ValueError(f"queries of {size['least']} to {size['most']} components")
    v = v.where((F.size("v") == F.lit(size["most"])) & ~F.exists("v", lambda x: x.isNull()))
    if size["n"] == 0:
        candidates = v.sparkSession.createDataFrame([], _OUT)
    elif size["bytes"] <= broadcast_bytes:
        candidates = _by_broadcast(q, v, k, metric, bool(within))
    else:
        candidates = _by_grid(q, v, size["n"], v.count(), k, metric, bool(within))
    nearest = W.partitionBy("query_id").orderBy("d", "vec_id")
    sign = -1.0 if metric == "cosine" else 1.0
    return (
        candidates.withColumn("rank", F.row_number().over(nearest))
        .where(F.col("rank") <= k)
        .select("query_id", "vec_id", (F.col("d") * sign + 0.0).alias("score"), "rank")
    )


def knn_by_section(
    queries: DataFrame, vectors: DataFrame, k: int = 5, legacy_order: bool = False, **columns
) -> DataFrame:
    """k-NN inside the sections each query names.

    `legacy_order` takes the `k` nearest of each section, orders them farthest-first and
    cuts that list at `k`.
    """
    if not legacy_order:
        return knn(queries, vectors, k, within=("sections", "section"), **columns)
    name = columns.pop("query_id", "query_id")
    parts = queries.select("*", F.posexplode("sections").alias("_at", "_section"))
    # Parts get numbers of their own, which lead back to any query id.
    parts = materialize(
        parts.withColumn("_part", F.monotonically_increasing_id()).withColumn("_sections", F.array("_section")), "query-parts"
    )
    hits = knn(parts, vectors, k, query_id="_part", within=("_sections", "section"), **columns)
    owners = parts.select("_part", F.col(name).cast("bigint").alias("_owner"))
    farthest = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.join(owners, hits["query_id"] == owners["_part"])
        .select(F.col("_owner").alias("query_id"), "vec_id", "score")
        .withColumn("rank", F.row_number().over(farthest))
        .where(F.col("rank") <= k)
    )


def section_index(vectors: DataFrame, known: DataFrame) -> DataFrame:
    """`vectors` with normalised `section`; names not among `known`'s go under `default`."""
    names = small_side(known.select(normalize_section(F.col("section")).alias("_known")).distinct())
    named = vectors.withColumn("section", normalize_section(F.col("section")))
    placed = named.join(names, F.col("section") == F.col("_known"), "left")
    return placed.withColumn("section", F.coalesce("_known", F.lit("default"))).drop("_known")


def knn_in_named_sections(queries: DataFrame, index: DataFrame, k: int = 5, metric: str = "cosine", **columns) -> DataFrame:
    """k-NN inside the sections of a `section_index` that each query names in any spelling.

    A missing name asks for `default`; a name that the index does not have finds nothing.
    """
    asked = queries.withColumn("sections", F.transform("sections", normalize_section))
    return knn_by_section(asked, index, k, metric=metric, **columns)


def normalize_vectors(df: DataFrame, col: str = "embedding") -> DataFrame:
    return df.withColumn(col, unit(F.col(col)))


def merge_topk(hits: DataFrame, k: int = 10, dedup: bool = True, nearest_first: bool = True) -> DataFrame:
    """Best `k` hits over all queries; with `dedup` a vector counts for the first query that found it."""
    if dedup:
        firsts = hits.groupBy("vec_id").agg(F.min("query_id").alias("query_id"))
        hits = hits.join(firsts, ["vec_id", "query_id"])
    score = F.asc("score") if nearest_first else F.desc("score")
    return hits.orderBy(score, "vec_id", "query_id").limit(k)


def flat_search(queries: DataFrame, vectors: DataFrame, k: int = 10, **columns) -> DataFrame:
    """Search each query in its first section only, then merge over all queries."""
    first = queries.withColumn("sections", F.slice("sections", 1, 1))
    return merge_topk(knn_by_section(first, vectors, k, **columns), k)
