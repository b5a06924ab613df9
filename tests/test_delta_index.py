import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusengine.operators import ann, knn
from corpusengine.sources import delta_index
from tests.conftest import rows

KINDS = "id long, embedding array<double>, cell long"


def made(spark, ids, cell=0, x=0.0):
    return spark.createDataFrame([(i, [float(i), x], cell if cell is not None else i % 3) for i in ids], KINDS)


@pytest.fixture
def folder(spark, tmp_path):
    delta_index.create(made(spark, range(30), None), str(tmp_path / "index"))
    return str(tmp_path / "index")


def state(spark, folder):
    return {r.id: (r.cell, r.embedding[1]) for r in delta_index.read(spark, folder).collect()}


def test_updates_and_deletions(spark, folder):
    want = {i: (i % 3, 0.0) for i in range(30)}
    assert state(spark, folder) == want
    delta_index.apply(spark, folder, 0, made(spark, [3, 40], 2, 1.0), spark.createDataFrame([(5,), (99,)], "id long"))
    want |= {3: (2, 1.0), 40: (2, 1.0)}
    del want[5]
    assert state(spark, folder) == want
    delta_index.apply(spark, folder, 1, made(spark, [5], 1, 2.0), spark.createDataFrame([(3,)], "id long"))
    want |= {5: (1, 2.0)}
    del want[3]
    assert state(spark, folder) == want
    assert delta_index.compact(spark, folder) == 2 and state(spark, folder) == want
    assert delta_index.compact(spark, folder) == 2
    # Batch 1 is part of the base now and is not applied again.
    delta_index.apply(spark, folder, 1, made(spark, [3], 0, 9.0))
    assert state(spark, folder) == want
    delta_index.apply(spark, folder, 2, made(spark, [3], 0, 3.0))
    assert state(spark, folder) == want | {3: (0, 3.0)}


def test_a_batch_counts_when_it_is_committed(spark, folder, monkeypatch):
    before = state(spark, folder)
    with monkeypatch.context() as patched:
        patched.setattr(type(spark), "range", lambda *_: (_ for _ in ()).throw(RuntimeError("lost driver")))
        with pytest.raises(RuntimeError):
            delta_index.apply(spark, folder, 0, made(spark, [1, 2], 1, 7.0))
    assert state(spark, folder) == before
    for x in (7.0, 8.0):  # the next try, and a replay of it
        delta_index.apply(spark, folder, 0, made(spark, [1], 1, x))
    assert state(spark, folder) == before | {1: (1, 8.0)}


def test_a_crash_in_compaction_leaves_the_old_base(spark, folder, monkeypatch):
    delta_index.apply(spark, folder, 0, made(spark, [1], 1, 7.0))
    want = state(spark, folder)
    with monkeypatch.context() as patched:
        patched.setattr(delta_index, "_set_head", lambda *_: (_ for _ in ()).throw(RuntimeError("lost driver")))
        with pytest.raises(RuntimeError):
            delta_index.compact(spark, folder)
    assert state(spark, folder) == want
    assert delta_index.compact(spark, folder) == 2 and state(spark, folder) == want


def test_a_search_reads_the_asked_cells_of_base_and_deltas(spark, tmp_path):
    draw = np.random.default_rng(1)
    vectors = spark.createDataFrame(
        [(i, (draw.normal(size=4) + 8 * (i % 5)).tolist()) for i in range(200)], "id long, embedding array<double>"
    )
    centres = ann.ivf_train(vectors, 5)
    folder = str(tmp_path / "index")
    delta_index.create(ann.ivf_index(vectors.where("id < 150"), centres), folder)
    add = delta_index.sink(folder, centres, deleted="gone", every=2)
    late = vectors.where("id >= 140").withColumn("gone", F.col("id") % 10 == 0)
    add(late.where("id % 2 = 0"), 0)
    index = delta_index.read(spark, folder)
    plan = index.where("cell = 1")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*cell#\d+L = 1", plan)) == 2
    add(late.where("id % 2 = 1"), 1)
    left = vectors.where("id < 140 OR id % 10 <> 0")
    index = delta_index.read(spark, folder)
    asked = left.where("id % 20 = 1").withColumnRenamed("id", "query_id")
    got = ann.ivf_exact_search(asked, index, ann.ivf_cells(index, centres), 5, vec_id="id")
    assert rows(got, "query_id", "vec_id", "rank") == rows(knn.knn(asked, left, 5, vec_id="id"), "query_id", "vec_id", "rank")


def test_refusals(spark, folder):
    with pytest.raises(ValueError, match="not unique"):
        delta_index.apply(spark, folder, 0, made(spark, [1, 1]))
    delta_index.apply(spark, folder, 0)
    assert len(state(spark, folder)) == 30
