import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusengine.llm import hard_negatives
from corpusengine.llm.hard_negatives import Bucket

KINDS = "vec_id long, embedding array<float>, label int, place long, q int, `a.b` string"


def plain(rows, anchor, positives=5, negatives=5):
    """The contract over all pairs; rows with equal id, label and vector count once."""
    ready = {}
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = tuple(np.float32(x).item() for x in v)
        ready[vec_id, label, v] = (vec_id, label, [math.floor(256 * x) for x in v])
    ready = list(ready.values())
    out = []
    for a, label, q in ready:
        if not anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(q, w, strict=True)), b, other) for b, other, w in ready if b != a and len(w) == len(q)]
        for p, b, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            fits = sorted((s, c) for s, c, other in scored if other != label and 80 * -p <= 100 * -s <= 100 * -p)
            out.extend((a, b, rank, c, -p, -s) for rank, (s, c) in enumerate(fits[:negatives], 1))
    return sorted(out)


def vectors(n=600, dim=8, seed=2):
    """Clusters of different lengths, with ties, repeats and rows that take no part."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = (centres[i % 12] + draw.normal(scale=0.25, size=dim)) * (0.05 if i % 5 == 0 else 1.0 + i % 3)
        rows.append((i, [round(float(x), 1) for x in v], i % 4 if i % 12 < 9 else 1))
    rows += [(n, None, 1), (n + 10, [1.0] * dim, None), (n + 20, [None] + [1.0] * (dim - 1), 1), (None, [1.0] * dim, 1)]
    rows += [(n + 30, [float("nan")] * dim, 1), (n + 40, [float("inf")] * dim, 1), (n + 50, [0.0] * dim, 1), (n + 60, [0.0] * dim, 2)]
    rows += [(n + 70, [1.0, 2.0], 1), (n + 71, [1.0, 1.0], 1), (n + 72, [1.0, 1.9], 2), (n + 80, [], 1), (n + 81, [], 2)]
    rows += [rows[0]] * 3 + [rows[10]] * 20 + [(20, rows[21][1], 3), (40, rows[40][1], 2)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, 8, "x") for r in rows], KINDS)


@pytest.mark.parametrize(("bucket", "block"), [(4096, 2048), (64, 16)])
def test_against_all_pairs(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(hard_negatives, "BUCKET", bucket)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rows = vectors()
    got = hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain(rows, lambda a: a % 10 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200


def test_ranges_lose_nothing_and_leave_out_much():
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(40, 32))
    v = centres[draw.integers(0, 40, 2000)] + 0.1 * draw.normal(size=(2000, 32))
    q = np.floor(2560 * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.int64)
    bucket = Bucket(np.arange(2000), np.zeros(2000, np.int64), q)
    met = 0
    for i in range(0, 2000, 20):
        scores = bucket.scores(q[i])
        needed = int(np.sort(scores)[-6])
        rows = bucket.candidates(q[i], needed)
        assert rows is not None and set(np.flatnonzero(scores >= needed)) <= set(rows.tolist())
        met += len(rows)
    assert met < 0.1 * 100 * 2000
    assert len(bucket.candidates(q[0], 10**12)) == 0 and bucket.candidates(q[0], 0) is None


def test_random_windows_lose_nothing():
    draw = random.Random(5)
    for _ in range(200):
        q = np.array([[draw.randint(-300, 300) for _ in range(6)] for _ in range(60)])
        bucket = Bucket(np.arange(60), np.zeros(60, np.int64), q)
        scores = bucket.scores(q[0])
        needed = draw.randint(1, int(scores.max()) + 1)
        rows = bucket.candidates(q[0], needed)
        assert rows is None or set(np.flatnonzero(scores >= needed)) <= set(rows.tolist())


def test_scores_beyond_doubles_are_exact():
    big = (1 << 29) + 1
    bucket = Bucket(np.arange(2), np.zeros(2, np.int64), np.array([[big, 1], [big, 2]]))
    assert bucket.scores(np.array([big, 1])).tolist() == [big * big + 1, big * big + 2]


def test_empty_table_and_no_anchor(spark):
    for rows in ([], [(1, [1.0], 1), (2, [1.0], 2)], [(None, None, None)]):
        assert hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0).count() == 0
