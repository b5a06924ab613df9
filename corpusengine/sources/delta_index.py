"""A vector index that takes updates and deletions: a base, deltas with tombstones, and compaction.

    folder/base/generation=2/cell=7/*.parquet    all vectors up to the last compaction, by cell
    folder/delta/batch=5/cell=7/*.parquet        vectors that batch 5 adds or changes
    folder/touched/batch=5/*.parquet             ids that batch 5 adds, changes or deletes
    folder/commits/batch=5/*.parquet             one row, written last: the batch counts
    folder/heads/version=2/*.parquet             one row, written last: the generation that counts, batches merged into it

Readers take from the base what no later batch touched and from the deltas the last version of every id,
so only the narrow ids of the open batches are compared, and both sides stay cut by cell.  A batch that is sent again
overwrites its own folders.  What is written but not committed is not read.  One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusengine.operators.ann import ivf_index
from corpusengine.session import materialize, small_side

_HEAD = "generation BIGINT, merged BIGINT, key STRING, cell STRING, columns STRING"


def create(rows: DataFrame, folder: str, key: str = "id", by: str = "cell") -> None:
    """Write `rows`, one per `key`, as the base, clustered by the long column `by`."""
    _write(rows, f"{folder}/base/generation=1", by)
    _set_head(rows.sparkSession, folder, 1, -1, key, by, rows.schema.json())


def apply(spark: SparkSession, folder: str, batch: int, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> None:
    """Add or replace the rows of `upserts` and remove the ids of `deletes` as batch number `batch`.

    Later batches have higher numbers.  A batch that a compaction has merged is not applied again.
    """
    head = _head(spark, folder)
    if batch <= head["merged"]:
        return
    schema = T.StructType.fromJson(json.loads(head["columns"]))
    rows = spark.createDataFrame([], schema) if upserts is None else upserts.select(*schema.names)
    rows = materialize(rows, "index-batch")
    ids = rows.select(head["key"])
    if not ids.groupBy(head["key"]).count().where("count > 1").isEmpty():
        raise ValueError(f"{head['key']} is not unique")
    if deletes is not None:
        ids = ids.unionByName(deletes.select(head["key"])).distinct()
    _write(rows, f"{folder}/delta/batch={batch}", head["cell"])
    ids.write.mode("overwrite").parquet(f"{folder}/touched/batch={batch}")
    spark.range(1).write.mode("overwrite").parquet(f"{folder}/commits/batch={batch}")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The index with every committed batch; a filter on the cell reaches the files of base and deltas."""
    head = _head(spark, folder)
    schema = T.StructType.fromJson(json.loads(head["columns"]))
    key = head["key"]
    base = _rows(spark, f"{folder}/base/generation={head['generation']}", schema)
    open_batches = _open(spark, folder, head["merged"])
    if not open_batches:
        return base
    chosen = F.col("batch").isin(open_batches)
    touched_schema = T.StructType([schema[key], T.StructField("batch", T.LongType())])
    touched = spark.read.schema(touched_schema).parquet(f"{folder}/touched").where(chosen)
    latest = materialize(touched.groupBy(key).agg(F.max("batch").alias("batch")), "touched-ids")
    delta = _rows(spark, f"{folder}/delta", T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).where(chosen)
    untouched = base.join(small_side(latest.select(key)), key, "left_anti")
    return untouched.select(*schema.names).unionByName(delta.join(small_side(latest), [key, "batch"], "left_semi").select(*schema.names))


def compact(spark: SparkSession, folder: str) -> int:
    """Write base and open batches as a new base, and return its generation; readers of the old one are not disturbed."""
    head = _head(spark, folder)
    open_batches = _open(spark, folder, head["merged"])
    if not open_batches:
        return head["generation"]
    generation = head["generation"] + 1
    _write(read(spark, folder), f"{folder}/base/generation={generation}", head["cell"])
    _set_head(spark, folder, generation, max(open_batches), head["key"], head["cell"], head["columns"])
    return generation


def sink(folder: str, centres: DataFrame, vector: str = "embedding", deleted: str | None = None, every: int = 20) -> Callable[[DataFrame, int], None]:
    """The function for `writeStream.foreachBatch`: places vectors in cells, deletes the rows with `deleted`, compacts every so many batches."""

    def add(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        gone = None
        if deleted is not None:
            gone, rows = rows.where(F.col(deleted)), rows.where(F.col(deleted).isNull() | ~F.col(deleted)).drop(deleted)
        apply(spark, folder, batch, ivf_index(rows, centres, vector), gone)
        if batch % every == every - 1:
            compact(spark, folder)

    return add


# --- files ----------------------------------------------------------------------------------------


def _write(rows: DataFrame, path: str, by: str) -> None:
    rows.hint("rebalance", F.col(by)).write.mode("overwrite").partitionBy(by).parquet(path)


def _rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def _head(spark: SparkSession, folder: str):
    heads = spark.read.schema(f"{_HEAD}, version BIGINT").parquet(f"{folder}/heads")
    last = heads.agg(F.max("version")).first()[0]
    return heads.where(F.col("version") == last).first()


def _set_head(spark: SparkSession, folder: str, generation: int, merged: int, key: str, cell: str, columns: str) -> None:
    row = spark.createDataFrame([(generation, merged, key, cell, columns)], _HEAD).coalesce(1)
    row.write.mode("overwrite").parquet(f"{folder}/heads/version={generation}")


def _open(spark: SparkSession, folder: str, merged: int) -> list[int]:
    """Numbers of the committed batches after the last compaction."""
    commits = spark.read.schema("id BIGINT, batch BIGINT")
    try:
        found = commits.parquet(f"{folder}/commits").where(F.col("batch") > merged).select("batch").distinct().collect()
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted(r["batch"] for r in found)
