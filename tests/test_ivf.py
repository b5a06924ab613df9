import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusengine.operators import ann, knn
from corpusengine.sources import index as stored
from tests.conftest import rows

KINDS = "vec_id long, embedding array<double>"


def clustered(n=3000, dim=16, clusters=20, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(clusters, dim)) * 4
    return [(i, (centres[i % clusters] + 0.2 * draw.normal(size=dim)).tolist()) for i in range(n)]


def both(spark, vectors, queries, k, nlist, nprobe=1):
    table = spark.createDataFrame(vectors, KINDS)
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    centres = ann.ivf_train(table.where((F.size("embedding") == len(queries[0][1])) & ~F.exists("embedding", lambda x: x.isNull())), nlist)
    index = ann.ivf_index(table, centres)
    exact = ann.ivf_exact_search(asked, index, ann.ivf_cells(index, centres), k, nprobe)
    return rows(exact, "query_id", "vec_id", "score", "rank"), rows(knn.knn(asked, table, k), "query_id", "vec_id", "score", "rank")


@pytest.mark.parametrize(("k", "nprobe"), [(1, 1), (7, 1), (200, 2)])
def test_exact_on_clusters(spark, k, nprobe):
    vectors = clustered()
    got, want = both(spark, vectors, [(i, v) for i, v in vectors[::150]] + [(-1, [0.0] * 16)], k, 20, nprobe)
    assert got == want


def test_exact_on_noise_with_ties_and_odd_rows(spark):
    draw = np.random.default_rng(5)
    vectors = [(i, np.round(draw.normal(size=3), 1).tolist()) for i in range(300)]
    vectors += [(400 + i, [0.1, 0.1, 0.1]) for i in range(30)] + [(500, None), (501, []), (502, [1.0]), (503, [None, 1.0, 2.0])]
    got, want = both(spark, vectors, [(i, v) for i, v in vectors[:40]] + [(999, [0.1, 0.1, 0.1])], 12, 9)
    assert got == want


def test_fewer_vectors_than_asked(spark):
    vectors = clustered(30, 4, 3)
    got, want = both(spark, vectors, vectors[:3], 50, 3)
    assert got == want and len(got) == 90


def test_a_stored_index_reads_fewer_cells(spark, tmp_path):
    vectors = clustered()
    table = spark.createDataFrame(vectors, KINDS)
    centres = ann.ivf_train(table, 20)
    stored.save(ann.ivf_index(table, centres), str(tmp_path), by="cell", id_col="vec_id")
    index, _ = stored.load(spark, str(tmp_path))
    cells = ann.ivf_cells(index, centres)
    asked = spark.createDataFrame(vectors[:2], "query_id long, embedding array<double>")
    hits = ann.ivf_exact_search(asked, index, cells, 5)
    assert rows(hits, "query_id", "vec_id") == rows(knn.knn(asked, table, 5), "query_id", "vec_id")
    probes = [max(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/corpusengine/{p}-*"), key=os.path.getmtime) for p in ("first-probes", "second-probes")]
    read = {r.c for p in probes for r in spark.read.parquet(p).select(F.explode("_cells").alias("c")).collect()}
    # Two queries in two far clusters of twenty.
    assert len(read) <= 6


def test_an_empty_index_finds_nothing(spark):
    table = spark.createDataFrame(clustered(40, 4, 2), KINDS)
    centres = ann.ivf_train(table, 2)
    index = ann.ivf_index(table.limit(0), centres)
    asked = spark.createDataFrame([(1, [0.0] * 4)], "query_id long, embedding array<double>")
    assert ann.ivf_exact_search(asked, index, ann.ivf_cells(index, centres), 5).count() == 0
