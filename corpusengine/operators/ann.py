"""Approximate k-NN: inverted file over k-means cells, and sign hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusengine.operators.knn import DECIMALS, knn
from corpusengine.session import materialize


def ivf_train(vectors: DataFrame, nlist: int = 100, vec: str = "embedding", seed: int = 7, rounds: int = 20) -> DataFrame:
    """Cell centres `(cell, embedding)`; fails when there are fewer vectors than cells."""
    ready = vectors.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(
        array_to_vector(F.col(vec).cast("array<double>")).alias("features")
    )
    if ready.limit(nlist).count() < nlist:
        raise ValueError(f"training needs at least {nlist} vectors")
    model = KMeans(k=nlist, seed=seed, maxIter=rounds, initMode="k-means||").fit(ready)
    return _centre_table(vectors.sparkSession, model.clusterCenters())


def _centre_table(spark: SparkSession, centres) -> DataFrame:
    return spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell BIGINT, embedding ARRAY<DOUBLE>"
    )


def ivf_assign(vectors: DataFrame, centres: DataFrame, vec: str = "embedding") -> DataFrame:
    """Adds `cell`, the nearest centre; the centres, `nlist` rows, travel with the function."""
    rows = centres.orderBy("cell").collect()
    cells = np.array([r["cell"] for r in rows], dtype=np.int64)
    matrix = np.array([r["embedding"] for r in rows], dtype=np.float64)
    half = (matrix * matrix).sum(1) / 2.0

    @F.pandas_udf(T.LongType())
    def nearest(batch: pd.Series) -> pd.Series:
        points = np.stack(batch.to_numpy()).astype(np.float64)
        return pd.Series(cells[np.argmin(half[None, :] - points @ matrix.T, axis=1)])

    return vectors.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).withColumn("cell", nearest(F.col(vec)))


def ivf_search(queries: DataFrame, index: DataFrame, centres: DataFrame, k: int = 5, nprobe: int = 1, **columns) -> DataFrame:
    """k-NN among the vectors in the `nprobe` cells nearest to each query; all cells make it exact."""
    probes = knn(queries, centres, nprobe, vec_id="cell", **_query_side(columns))
    cells = probes.groupBy("query_id").agg(F.collect_list("vec_id").alias("cells"))
    qid = columns.get("query_id", "query_id")
    probing = queries.join(cells.withColumnRenamed("query_id", "_q"), F.col(qid) == F.col("_q")).drop("_q")
    return knn(materialize(probing, "probes"), index, k, within=("cells", "cell"), **columns)


def ivf_index(vectors: DataFrame, centres: DataFrame, vec: str = "embedding") -> DataFrame:
    """Adds `cell`, the nearest centre, and `to_centre`, the distance to it.

    Vectors of another length than the centres', or with a null among them, cannot be placed and are left out.
    """
    rows = centres.orderBy("cell").collect()
    cells = np.array([r["cell"] for r in rows], dtype=np.int64)
    matrix = np.array([r["embedding"] for r in rows], dtype=np.float64)
    half = (matrix * matrix).sum(1) / 2.0

    @F.pandas_udf("cell bigint, to_centre double")
    def nearest(batch: pd.Series) -> pd.DataFrame:
        points = np.stack(batch.to_numpy()).astype(np.float64)
        at = np.argmin(half[None, :] - points @ matrix.T, axis=1)
        # By differences: the expanded square would lose the digits that the bounds need.
        return pd.DataFrame({"cell": cells[at], "to_centre": np.sqrt(((points - matrix[at]) ** 2).sum(1))})

    fits = F.col(vec).isNotNull() & (F.size(vec) == matrix.shape[1]) & ~F.exists(vec, lambda x: x.isNull())
    return vectors.where(fits).withColumn("_ivf", nearest(F.col(vec))).select(*vectors.columns, "_ivf.cell", "_ivf.to_centre")


def ivf_cells(index: DataFrame, centres: DataFrame) -> DataFrame:
    """`(cell, embedding, n, radius)` of the cells that hold vectors; written, it serves any number of searches."""
    sizes = index.groupBy("cell").agg(F.count("*").alias("n"), F.max("to_centre").alias("radius"))
    return materialize(sizes.join(centres, "cell").select("cell", "embedding", "n", "radius"), "ivf-cells")


def ivf_exact_search(
    queries: DataFrame, index: DataFrame, cells: DataFrame, k: int = 5, nprobe: int = 1, **columns
) -> DataFrame:
    """The exact `k` nearest vectors by squared distance, reading only the cells that can hold them.

    Two rounds: a query first reads its nearest cells, `nprobe` of them or as many as it takes to hold `k`
    vectors.  A vector of a cell is no nearer than the distance to the centre less the cell's radius,
    so the second round reads the other cells where that is not beyond the k-th hit.
    """
    qid, qvec = columns.get("query_id", "query_id"), columns.get("query_vec", "embedding")
    rows = cells.orderBy("cell").collect()  # one row per cell, as many as the index was trained with
    if not rows:
        return knn(queries, index, k, **columns)
    names = np.array([r["cell"] for r in rows], dtype=np.int64)
    matrix = np.array([r["embedding"] for r in rows], dtype=np.float64)
    sizes = np.array([r["n"] for r in rows], dtype=np.int64)
    radii = np.array([r["radius"] for r in rows], dtype=np.float64)

    def away(point) -> np.ndarray:
        return np.sqrt(((matrix - np.asarray(point, np.float64)) ** 2).sum(1))

    @F.pandas_udf("array<bigint>")
    def nearest_cells(points: pd.Series) -> pd.Series:
        def pick(point):
            order = np.argsort(away(point), kind="stable")
            enough = int(np.searchsorted(np.cumsum(sizes[order]), k)) + 1
            return names[order[: max(nprobe, enough)]]

        return points.map(pick)

    @F.pandas_udf("array<bigint>")
    def cells_in_reach(points: pd.Series, reach: pd.Series, done: pd.Series) -> pd.Series:
        def pick(point, square, before):
            # Scores are compared at DECIMALS decimals, so what rounds to the k-th score still counts.
            limit = np.inf if np.isnan(square) else np.sqrt(square + 10.0**-DECIMALS) * (1 + 1e-9)
            near = away(point) - radii * (1 + 1e-9) <= limit
            return names[near & ~np.isin(names, before)]

        return pd.Series([pick(*x) for x in zip(points, reach, done, strict=True)])

    asked = queries.where(F.col(qvec).isNotNull() & (F.size(qvec) == matrix.shape[1]))
    asked = materialize(asked.withColumn("_cells", nearest_cells(F.col(qvec))), "first-probes")
    near = materialize(knn(asked, index, k, within=("_cells", "cell"), **columns), "first-hits")
    reach = near.groupBy(F.col("query_id").alias("_q")).agg(F.when(F.count("*") >= k, F.max("score")).alias("_reach"))
    later = asked.join(reach, F.col(qid).cast("bigint") == F.col("_q"), "left").withColumn(
        "_cells", cells_in_reach(F.col(qvec), F.col("_reach"), F.col("_cells"))
    )
    later = materialize(later.drop("_q", "_reach").where(F.size("_cells") > 0), "second-probes")
    found = near.unionByName(knn(later, index, k, within=("_cells", "cell"), **columns)).drop("rank")
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _query_side(columns: dict) -> dict:
    return {c: v for c, v in columns.items() if c in ("query_id", "query_vec", "broadcast_bytes")}


def lsh_codes(df: DataFrame, dim: int, bits: int = 8, seed: int = 7, vec: str = "embedding", out: str = "code") -> DataFrame:
    """Adds the sign code of each vector on `bits` seeded random directions."""
    planes = np.random.default_rng(seed).normal(size=(bits, dim))
    weights = 1 << np.arange(bits, dtype=np.int64)

    @F.pandas_udf(T.LongType())
    def code(batch: pd.Series) -> pd.Series:
        points = np.stack(batch.to_numpy()).astype(np.float64)
        return pd.Series((points @ planes.T > 0) @ weights)

    return df.withColumn(out, code(F.col(vec)))


def lsh_search(queries: DataFrame, index: DataFrame, dim: int, k: int = 5, bits: int = 8, seed: int = 7, **columns) -> DataFrame:
    """k-NN among the vectors whose code differs from the query's in at most one bit.

    `index` carries `code` from `lsh_codes` with the same `dim`, `bits` and `seed`.
    """
    coded = lsh_codes(queries, dim, bits, seed, columns.get("query_vec", "embedding"), "_code")
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << b).cast("bigint") for b in range(bits)])
    probing = coded.withColumn("codes", F.transform(flips, lambda f: F.col("_code").bitwiseXOR(f)))
    return knn(probing, index, k, within=("codes", "code"), **columns)


def hashed_planes(dim: int, tables: int, bits: int) -> np.ndarray:
    """`tables` x `bits` directions of signs, each the first bit of the MD5 of `table:bit:component`, so that SQL can make them too."""
    sign = lambda t, b, j: 1.0 if hashlib.md5(f"{t}:{b}:{j}".encode()).digest()[0] < 128 else -1.0
    return np.array([[[sign(t, b, j) for j in range(dim)] for b in range(bits)] for t in range(tables)])


def lsh_index(vectors: DataFrame, dim: int, tables: int = 6, bits: int = 8, vec: str = "embedding") -> DataFrame:
    """Every vector once per table, with `bucket`, the number of its table and code.

    Stored by `bucket`, a search reads the buckets it probes.  Vectors of another length, or with a null, are left out.
    """
    planes = hashed_planes(dim, tables, bits).reshape(tables * bits, dim)
    weights = 1 << np.arange(bits, dtype=np.int64)

    @F.pandas_udf("array<bigint>")
    def buckets(batch: pd.Series) -> pd.Series:
        side = (np.stack(batch.to_numpy()).astype(np.float64) @ planes.T > 0).reshape(-1, tables, bits)
        return pd.Series(list(side @ weights + (np.arange(tables, dtype=np.int64) << bits)))

    fits = F.col(vec).isNotNull() & (F.size(vec) == dim) & ~F.exists(vec, lambda x: x.isNull())
    return vectors.where(fits).withColumn("bucket", F.explode(buckets(F.col(vec))))


def lsh_probes(queries: DataFrame, dim: int, tables: int = 6, bits: int = 8, probes: int = 2, vec: str = "embedding") -> DataFrame:
    """Adds `buckets`: per table the query's own and the `probes` across its nearest planes."""
    planes = hashed_planes(dim, tables, bits).reshape(tables * bits, dim)
    weights = 1 << np.arange(bits, dtype=np.int64)

    @F.pandas_udf("array<bigint>")
    def probed(batch: pd.Series) -> pd.Series:
        away = (np.stack(batch.to_numpy()).astype(np.float64) @ planes.T).reshape(-1, tables, bits)
        own = (away > 0) @ weights
        nearest = np.argsort(np.abs(away), axis=2, kind="stable")[:, :, :probes]
        codes = np.concatenate([own[:, :, None], own[:, :, None] ^ (1 << nearest.astype(np.int64))], axis=2)
        codes += (np.arange(tables, dtype=np.int64) << bits)[None, :, None]
        return pd.Series(list(codes.reshape(len(codes), -1)))

    fits = F.col(vec).isNotNull() & (F.size(vec) == dim) & ~F.exists(vec, lambda x: x.isNull())
    return queries.where(fits).withColumn("buckets", probed(F.col(vec)))


def lsh_tables_search(
    queries: DataFrame, index: DataFrame, dim: int, k: int = 5, tables: int = 6, bits: int = 8, probes: int = 2, **columns
) -> DataFrame:
    """k-NN among the vectors that share a probed bucket with the query in any of the tables of a `lsh_index`.

    A vector is met at most once per table, so the `k * tables` nearest meetings hold the `k` nearest vectors.
    """
    asked = materialize(lsh_probes(queries, dim, tables, bits, probes, columns.get("query_vec", "embedding")), "lsh-probes")
    met = knn(asked, index, k * tables, within=("buckets", "bucket"), **columns).drop("rank")
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return met.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
