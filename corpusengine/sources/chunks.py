"""Chunk table: scans, incremental reads, upsert, samples, administration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def embedded(chunks: DataFrame, vector: str = "embedding") -> DataFrame:
    """Chunks that carry a vector."""
    return chunks.where(F.col(vector).isNotNull() & (F.size(vector) > 0))


def chunks_after(chunks: DataFrame, last_id: int, id_col: str = "id") -> DataFrame:
    """Chunks beyond the watermark; the comparison is pushed down to the scan."""
    return chunks.where(F.col(id_col) > last_id)


def last_id(chunks: DataFrame, id_col: str = "id") -> int:
    """Highest id present, 0 for an empty table."""
    return chunks.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]


def sample(chunks: DataFrame, n: int = 2, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """First `n` chunks by id, the vector replaced by its length."""
    return (
        chunks.orderBy(id_col).limit(n).withColumn("embedding_len", F.size(vector)).drop(vector)
    )


def upsert(
    target: DataFrame, source: DataFrame, key: str = "id", keep: tuple[str, ...] = ("created_at",)
) -> DataFrame:
    """Rows of `target` after inserting `source` and updating on equal `key`.

    Columns in `keep` hold the target's value for existing keys.  One full outer join on
    the key: both sides are shuffled once (or not at all when bucketed by it).
    """
    in_source = F.col("new._in_source")
    columns = []
    for c in target.columns:
        was, now = F.col(f"old.`{c}`"), F.col(f"new.`{c}`") if c in source.columns else F.lit(None)
        if c == key:
            value = F.coalesce(was, now)
        elif c in keep:
            value = F.when(F.col("old._in_target"), was).otherwise(now)
        else:
            value = F.when(in_source, now).otherwise(was)
        columns.append(value.cast(target.schema[c].dataType).alias(c))
    joined = (
        target.withColumn("_in_target", F.lit(True)).alias("old")
        .join(
            source.withColumn("_in_source", F.lit(True)).alias("new"),
            F.col(f"old.`{key}`") == F.col(f"new.`{key}`"),
            "full",
        )
    )
    return joined.select(*columns)


def reset(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def describe(spark: SparkSession, table: str) -> DataFrame:
    """Column names and types of a table."""
    return spark.createDataFrame(
        [(c.name, c.dataType, c.nullable) for c in spark.catalog.listColumns(table)],
        "column STRING, type STRING, nullable BOOLEAN",
    )
