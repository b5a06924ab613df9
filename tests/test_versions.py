import glob
import re

import pytest
from pyspark.sql import functions as F

from corpusengine.sources import versions
from tests.conftest import rows

KINDS = "id long, text string, created_at string"


def files(folder, version, bucket):
    return {f.rsplit("/", 1)[1] for f in glob.glob(f"{folder}/data/version={version}/bucket={bucket}/*.parquet")}


def read_files(df):
    """Files with rows of `df`; the partition filter must stand in the plan."""
    assert re.search(r"PartitionFilters: \[[^\]]", df._jdf.queryExecution().executedPlan().toString())
    return {"/".join(r[0].rsplit("/", 3)[1:]) for r in df.select(F.input_file_name()).distinct().collect()}


@pytest.fixture
def folder(spark, tmp_path):
    base = spark.createDataFrame([(i, f"t{i}", "old") for i in range(-5, 35)], KINDS)
    versions.create(base, str(tmp_path / "table"), "id", width=10)
    return str(tmp_path / "table")


def test_upsert_rewrites_only_touched_buckets(spark, folder):
    untouched = {b: files(folder, 1, b) for b in (-1, 0, 2, 3)}
    source = spark.createDataFrame([(12, "new12", "x"), (19, "new19", "x"), (100, "new100", "x")], KINDS)
    assert versions.upsert(spark, folder, source, "one", keep=("created_at",)) == 2
    got = {r.id: (r.text, r.created_at) for r in versions.read(spark, folder).collect()}
    want = {i: (f"t{i}", "old") for i in range(-5, 35)} | {12: ("new12", "old"), 19: ("new19", "old"), 100: ("new100", "x")}
    assert got == want
    assert {b: files(folder, 1, b) for b in untouched} == untouched and not files(folder, 2, 0)
    used = read_files(versions.read(spark, folder))
    assert {f.rsplit("/", 1)[0] for f in used} == {f"version=1/bucket={b}" for b in (-1, 0, 2, 3)} | {f"version=2/bucket={b}" for b in (1, 10)}
    assert rows(versions.history(spark, folder), "version", "batch", "n_buckets", "n_rewritten") == [(1, "create", 5, 5), (2, "one", 6, 2)]
    assert {r.text for r in versions.read(spark, folder, version=1).collect()} == {f"t{i}" for i in range(-5, 35)}


def test_a_key_range_reads_its_buckets_only(spark, folder):
    some = versions.read(spark, folder, low=-2, high=12)
    assert sorted(r.id for r in some.collect()) == list(range(-2, 13))
    assert {f.rsplit("/", 1)[0] for f in read_files(some)} == {f"version=1/bucket={b}" for b in (-1, 0, 1)}
    assert versions.read(spark, folder, low=1000).count() == 0


def test_a_crash_before_the_manifest_shows_the_old_version(spark, folder, monkeypatch):
    source = spark.createDataFrame([(1, "new", "x")], KINDS)

    def crash(*_):
        raise RuntimeError("lost driver")

    with monkeypatch.context() as patched:
        patched.setattr(versions, "_commit", crash)
        with pytest.raises(RuntimeError):
            versions.upsert(spark, folder, source, "one")
    assert files(folder, 2, 0)
    assert versions.read(spark, folder).where("id = 1").first().text == "t1"
    assert versions.upsert(spark, folder, source, "one") == 2
    assert versions.read(spark, folder).where("id = 1").first().text == "new"
    assert versions.read(spark, folder).count() == 40


def test_a_batch_is_applied_once(spark, folder):
    for text in ("first", "again"):
        source = spark.createDataFrame([(1, text, "x")], KINDS)
        assert versions.upsert(spark, folder, source, "same") == 2
    assert versions.read(spark, folder).where("id = 1").first().text == "first"
    assert versions.upsert(spark, folder, spark.createDataFrame([(1, "later", "x")], KINDS), "other") == 3
    assert versions.upsert(spark, folder, spark.createDataFrame([], KINDS), "empty") == 4
    assert versions.read(spark, folder).count() == 40


def test_many_buckets_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "PUSHED_KEYS", 3)
    folder = str(tmp_path / "t")
    versions.create(spark.range(60).select("id", F.lit("a").alias("text")), folder, width=10)
    versions.upsert(spark, folder, spark.range(5, 15).select("id"), "b")
    assert rows(versions.read(spark, folder)) == [(i, "a") for i in range(60)]


def test_refusals(spark, folder, tmp_path):
    twice = spark.createDataFrame([(1, "a", "x"), (1, "b", "x")], KINDS)
    with pytest.raises(ValueError, match="not unique"):
        versions.upsert(spark, folder, twice, "twice")
    with pytest.raises(Exception, match="without key"):
        versions.upsert(spark, folder, spark.createDataFrame([(None, "a", "x")], KINDS), "null")
    with pytest.raises(ValueError, match="already"):
        versions.create(twice, folder)
    with pytest.raises(ValueError, match="no table"):
        versions.read(spark, str(tmp_path / "nothing"))
    versions.create(spark.createDataFrame([], KINDS), str(tmp_path / "empty"))
    assert versions.read(spark, str(tmp_path / "empty")).count() == 0
    assert versions.read(spark, folder).count() == 40
