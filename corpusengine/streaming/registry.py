"""A log-structured table of bands: which kept texts share a bucket with new ones.

    folder/bands/level=0/run=5/slice=17/*.parquet      (bucket, id) that batch 5 adds, sorted by bucket
    folder/signatures/level=0/run=5/*.parquet          (id, signature) that batch 5 adds, sorted by id
    folder/bands/level=1/run=9/..., folder/signatures/level=1/run=9/...    runs merged at the end of batch 9
    folder/heads/version=9/*.parquet                   (level, run) of all runs that count after batch 9, written last

A slice is a bucket modulo `SLICES`, so a small batch reads only the slices that its buckets fall into, and in
them the row groups of its buckets; signatures are read by the ids found.  `FAN` runs of a level are merged into one of the next,
so there are few runs and each row is rewritten as often as there are levels.  Ids hold the number
of their batch, so none is asked for.  A batch that is sent again reads the head before it and
overwrites its own folders; what no head names is not read.  One writer at a time.
Folders of merged runs are not removed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusengine.session import among, materialize

#: Parts of a run by bucket.
SLICES = 64
#: Runs of a level that are merged into one.
FAN = 8
#: Low bits of an id, which number the texts of a batch from 1; the others hold the batch.
BATCH_BITS = 33

Runs = list[tuple[int, int]]


def batch_id(batch: int, number: Column) -> Column:
    """Id of a text by its number in the batch; ids of later batches are greater."""
    return F.lit(batch << BATCH_BITS).cast("bigint") + number


def runs_before(spark: SparkSession, folder: str, batch: int) -> Runs:
    """`(level, run)` of the runs that hold all batches before `batch`."""
    heads = spark.read.schema("level BIGINT, run BIGINT, version BIGINT").option("basePath", f"{folder}/heads")
    try:
        last = heads.parquet(f"{folder}/heads/version={batch - 1}")
    except AnalysisException as missing:
        _only_missing(missing)
        # The batch before left no head: batches are not numbered without gaps, or this is the first.
        try:
            before = heads.parquet(f"{folder}/heads").where(F.col("version") < batch)
        except AnalysisException as none:
            _only_missing(none)
            return []
        last = before.where(F.col("version") == F.lit(before.agg(F.max("version")).first()[0]))
    return sorted((r["level"], r["run"]) for r in last.collect())


def bands(spark: SparkSession, folder: str, runs: Runs) -> DataFrame:
    """`(bucket, id, slice)` of the runs."""
    return _read(spark, f"{folder}/bands", runs, "bucket BIGINT, id BIGINT, slice INT").select("bucket", "id", "slice")


def related(spark: SparkSession, folder: str, runs: Runs, buckets: DataFrame) -> DataFrame:
    """`(id, signature)` of the registered texts that lie in one of the `buckets`."""
    if not runs:
        return spark.createDataFrame([], "id BIGINT, signature ARRAY<BIGINT>")
    asked = materialize(buckets.select("bucket").distinct(), "asked-buckets")
    slices = [r[0] for r in asked.select(_slice().alias("slice")).distinct().collect()]
    held = among(bands(spark, folder, runs).where(F.col("slice").isin(slices)), "bucket", asked)
    ids = materialize(held.select("id").distinct(), "registered-ids")
    signatures = _read(spark, f"{folder}/signatures", runs, "id BIGINT, signature ARRAY<BIGINT>")
    return among(signatures.select("id", "signature"), "id", ids)


def add(spark: SparkSession, folder: str, batch: int, runs: Runs, kept: DataFrame, buckets: DataFrame, fan: int = FAN) -> None:
    """Add the texts `kept` (id, signature) with their `buckets` (id, bucket) as batch number `batch` to the `runs` before it."""
    _write(folder, (0, batch), kept, buckets.select("bucket", "id"))
    runs = [*runs, (0, batch)]
    merged, level = [], 0
    while len(same := [r for r in runs if r[0] == level]) >= (fan if level == 0 else fan - 1):
        merged += same
        level += 1
    if merged:
        signatures = _read(spark, f"{folder}/signatures", merged, "id BIGINT, signature ARRAY<BIGINT>").select("id", "signature")
        _write(folder, (level, batch), signatures, bands(spark, folder, merged).select("bucket", "id"))
        runs = [*(r for r in runs if r not in merged), (level, batch)]
    head = spark.createDataFrame(runs, "level BIGINT, run BIGINT").coalesce(1)
    head.write.mode("overwrite").parquet(f"{folder}/heads/version={batch}")


def _slice() -> Column:
    return F.pmod("bucket", F.lit(SLICES)).cast("int")


def _path(root: str, run: tuple[int, int]) -> str:
    return f"{root}/level={run[0]}/run={run[1]}"


def _read(spark: SparkSession, root: str, runs: Runs, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, level INT, run BIGINT").option("basePath", root).parquet(*[_path(root, r) for r in runs])


def _write(folder: str, run: tuple[int, int], signatures: DataFrame, places: DataFrame) -> None:
    by_bucket = places.withColumn("slice", _slice()).hint("rebalance", F.col("slice")).sortWithinPartitions("slice", "bucket")
    by_bucket.write.mode("overwrite").partitionBy("slice").parquet(_path(f"{folder}/bands", run))
    ordered = signatures.repartitionByRange("id").sortWithinPartitions("id")
    ordered.write.mode("overwrite").parquet(_path(f"{folder}/signatures", run))


def _only_missing(error: AnalysisException) -> None:
    if error.getCondition() != "PATH_NOT_FOUND":
        raise error
