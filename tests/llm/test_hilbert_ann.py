import numpy as np
from pyspark.sql import functions as F

from corpusengine.llm import hilbert_ann as H
from tests.conftest import SF


def test_curve_visits_neighbours_in_turn():
    for dims, bits in ((2, 4), (3, 3)):
        axes = np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")
        cells = np.stack([a.ravel() for a in axes], axis=1)
        keys = H.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def brute(ids, matrix, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((matrix - matrix[ids.index(q)]) ** 2).sum(axis=1))
        out[q] = [(i, x) for x, i in sorted((x, i) for x, i in zip(d, ids, strict=True) if i != q)[:k]]
    return out


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 100)
    vectors = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/embeddings.parquet")
    got = {}
    for r in sorted(H.nearest(vectors, F.col("id") % 50 == 0).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    rows = vectors.select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, matrix = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
    want = brute(ids, matrix, [i for i in ids if i % 50 == 0])
    assert got.keys() == want.keys() and all([x[2] for x in v] == list(range(1, 11)) for v in got.values())
    hits = sum(len({x[0] for x in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    place = {i: n for n, i in enumerate(ids)}
    for q, found in got.items():
        assert all(x[1] == np.sqrt(((matrix[place[q]] - matrix[place[x[0]]]) ** 2).sum()) for x in found)


def test_odd_vectors(spark):
    rows = [
        (0, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]),
        (6, [float("inf"), 1.0]), (7, [1.0]), (None, [0.0, 2.0]), (8, [None, 1.0]), (9, []), (10, [0.0, 3.0]),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x"))
    got = {}
    for r in sorted(H.nearest(vectors, F.col("id") % 2 == 0).collect()):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got == {
        0: [(1, 1, 0.0), (2, 2, 1.0), (3, 10, 2.0)],
        2: [(1, 0, 1.0), (2, 1, 1.0), (3, 10, 5**0.5)],
        10: [(1, 0, 2.0), (2, 1, 2.0), (3, 2, 5**0.5)],
    }
    assert H.nearest(vectors.limit(0), F.lit(True)).count() == 0
    same = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    assert {r.query_id: 0 for r in H.nearest(same, F.col("id") < 3).collect()}.keys() == {0, 1, 2}
    assert sorted(r.vec_id for r in H.nearest(same, F.col("id") == 3).collect()) == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10]


def test_repeated_rows_take_no_places(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(40)]
    rows = rows * 2 + [rows[7]] * 18 + [(100, (np.array(rows[3][1]) + 0.001 * n).tolist()) for n in range(12)]
    want = {}
    for q, v in rows:
        if q < 40:
            least = {}
            for i, x in rows:
                if i != q:
                    d = np.sqrt(((np.float32(x).astype(float) - np.float32(v).astype(float)) ** 2).sum())
                    least[i] = min(d, least.get(i, d))
            want[q] = [i for _, i in sorted((d, i) for i, d in least.items())[:10]]
    got = {}
    for r in sorted(H.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") < 40).collect()):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == want
