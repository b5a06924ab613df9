"""A table in versions: buckets of key ranges, and a manifest that names the files of each version.

    folder/data/version=3/bucket=7/*.parquet      written once, never changed
    folder/manifests/version=3/*.parquet          (bucket, data_version) of all buckets, width, key, batch

An upsert writes new files for the buckets its keys fall into, then the manifest.  The manifest is
one file that appears when it is complete, and the highest one counts: a job that ends
before leaves the old version, its data files are written over by the next try.  Every manifest
names the batch it came from, so a batch that is sent again changes nothing.  One writer at a time.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusengine.session import PUSHED_KEYS, small_side
from corpusengine.sources import chunks

#: Keys of a bucket, unless `create` is told another number.
WIDTH = 1_000_000
_MANIFEST = "bucket BIGINT, data_version BIGINT, key STRING, width BIGINT, batch STRING, columns STRING"


def create(rows: DataFrame, folder: str, key: str = "id", width: int = WIDTH, batch: str = "create") -> None:
    """Write `rows` as version 1; `width` consecutive keys share a bucket."""
    spark = rows.sparkSession
    if _manifests(spark, folder) is not None:
        raise ValueError(f"{folder} holds a table already")
    _refuse_repeats(rows, key)
    _write(rows, folder, 1, key, width)
    _commit(_written(spark, folder, 1), folder, 1, key, width, batch, rows.schema)


def upsert(
    spark: SparkSession, folder: str, source: DataFrame, batch: str, keep: tuple[str, ...] = (), key: str | None = None
) -> int:
    """Insert `source`, update on equal keys, and return the version that holds it.

    Columns in `keep` hold the old value of existing keys, columns that `source` lacks stay.  Only
    buckets that `source` has keys of are read and written.  A `batch` that some version has already is
    not applied again.
    """
    manifests = _existing(spark, folder)
    before = manifests.where(F.col("batch") == batch).agg(F.max("version")).first()[0]
    if before is not None:
        return before
    last = _current(manifests)
    known = last.first()
    key, width, version = key or known["key"], known["width"], known["version"] + 1
    _refuse_repeats(source, key)
    touched = source.select(bucket_of(F.col(key), width).alias("bucket")).distinct()
    # One pass over the keys; a version has at most as many buckets as its manifest has rows.
    old = _files(spark, folder, last.join(small_side(touched), "bucket", "left_semi"), known["columns"])
    stay = (*keep, *(c for c in old.columns if c not in source.columns))
    _write(chunks.upsert(old, source, key, stay), folder, version, key, width)
    new = _written(spark, folder, version)
    stays = last.select("bucket", "data_version").join(small_side(new), "bucket", "left_anti")
    _commit(stays.unionByName(new.select("bucket", "data_version")), folder, version, key, width, batch, T.StructType.fromJson(json.loads(known["columns"])))
    return version


def read(spark: SparkSession, folder: str, version: int | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """The last version, or an earlier one, of the keys from `low` to `high`, ends included; other buckets are not read."""
    manifests = _existing(spark, folder)
    wanted = _current(manifests, version)
    known = wanted.first()
    if known is None:
        raise ValueError(f"{folder} has no version {version}")
    key, width = known["key"], known["width"]
    for bound, inside in ((low, F.col("bucket") >= bucket_of(F.lit(low), width)), (high, F.col("bucket") <= bucket_of(F.lit(high), width))):
        if bound is not None:
            wanted = wanted.where(inside)
    rows = _files(spark, folder, wanted, known["columns"])
    for bound, inside in ((low, F.col(key) >= F.lit(low)), (high, F.col(key) <= F.lit(high))):
        if bound is not None:
            rows = rows.where(inside)
    return rows


def history(spark: SparkSession, folder: str) -> DataFrame:
    """`(version, batch, n_buckets, n_rewritten)` of every version."""
    own = (F.col("bucket").isNotNull() & (F.col("data_version") == F.col("version"))).cast("bigint")
    return _existing(spark, folder).groupBy("version", "batch").agg(F.count("bucket").alias("n_buckets"), F.sum(own).alias("n_rewritten"))


def bucket_of(key: Column, width: int) -> Column:
    """Number of the key range; a null key fails the job."""
    return F.floor(F.coalesce(key.cast("bigint"), F.raise_error(F.lit("a row without key"))) / F.lit(width)).cast("bigint")


# --- files ----------------------------------------------------------------------------------------


def _manifests(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{_MANIFEST}, version BIGINT").option("basePath", f"{folder}/manifests").parquet(f"{folder}/manifests")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _existing(spark: SparkSession, folder: str) -> DataFrame:
    manifests = _manifests(spark, folder)
    if manifests is None:
        raise ValueError(f"no table in {folder}")
    return manifests


def _current(manifests: DataFrame, version: int | None = None) -> DataFrame:
    """The manifest of one version; `version` is a partition, so finding the last one reads no file's rows."""
    if version is None:
        version = manifests.agg(F.max("version")).first()[0]
    return manifests.where(F.col("version") == version)


def _write(rows: DataFrame, folder: str, version: int, key: str, width: int) -> None:
    placed = rows.withColumn("bucket", bucket_of(F.col(key), width))
    # A bucket of many rows is spread over several files.
    placed.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/version={version}")


def _written(spark: SparkSession, folder: str, version: int) -> DataFrame:
    data = spark.read.schema("bucket BIGINT").parquet(f"{folder}/data/version={version}")
    return data.select("bucket").distinct().withColumn("data_version", F.lit(version).cast("bigint"))


def _commit(entries: DataFrame, folder: str, version: int, key: str, width: int, batch: str, schema: T.StructType) -> None:
    """The manifest of `version`, in one file, which makes it the current one; an empty table has one row without bucket."""
    spark = entries.sparkSession
    head = spark.range(1).select(F.lit(None).cast("bigint").alias("bucket"), F.lit(version).cast("bigint").alias("data_version"))
    whole = head.unionByName(entries.select("bucket", "data_version")).select(
        "bucket", "data_version", F.lit(key).alias("key"), F.lit(width).cast("bigint").alias("width"),
        F.lit(batch).alias("batch"), F.lit(schema.json()).alias("columns"),
    )
    whole.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifests/version={version}")


def _files(spark: SparkSession, folder: str, entries: DataFrame, columns: str) -> DataFrame:
    """Rows of the buckets that `entries` names: as a filter on the partitions, or as a join if there are very many."""
    schema = T.StructType.fromJson(json.loads(columns))
    entries = entries.where("bucket IS NOT NULL").select("bucket", "data_version")
    few = entries.limit(PUSHED_KEYS + 1).collect()
    if not few:
        return spark.createDataFrame([], schema)
    placed = T.StructType([*schema.fields, T.StructField("version", T.LongType()), T.StructField("bucket", T.LongType())])
    data = spark.read.schema(placed).parquet(f"{folder}/data")
    if len(few) > PUSHED_KEYS:
        named = entries.withColumnRenamed("data_version", "version")
        return data.join(small_side(named), ["version", "bucket"], "left_semi").select(*schema.names)
    chosen = F.lit(False)
    for version in sorted({r["data_version"] for r in few}):
        buckets = [r["bucket"] for r in few if r["data_version"] == version]
        chosen = chosen | ((F.col("version") == version) & F.col("bucket").isin(buckets))
    return data.where(chosen).select(*schema.names)


def _refuse_repeats(rows: DataFrame, key: str) -> None:
    if not rows.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
