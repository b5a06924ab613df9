"""Vector index as a Parquet table partitioned by section or cell, plus its watermark."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(index: DataFrame, folder: str, by: str = "section", id_col: str = "id", mode: str = "overwrite") -> None:
    """Write vectors clustered by `by` and the highest id as the watermark.

    Rows of one key are spread over several files by AQE's rebalance, so a key that holds
    a large share of the table does not end up in one task.
    """
    index.hint("rebalance", F.col(by)).write.mode(mode).partitionBy(by).parquet(f"{folder}/vectors")
    stored = index.sparkSession.read.parquet(f"{folder}/vectors")
    mark = stored.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint").alias("last_id"))
    mark.write.mode("overwrite").parquet(f"{folder}/watermark")


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, int] | None:
    """The stored vectors and the watermark, or None if nothing is stored."""
    try:
        vectors = spark.read.parquet(f"{folder}/vectors")
        mark = spark.read.parquet(f"{folder}/watermark").first()[0]
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return vectors, mark


def stats(index: DataFrame, by: str | None = None, vector: str = "embedding") -> DataFrame:
    """Number of vectors and their dimension, for the whole index or per key."""
    measures = [
        F.count("*").alias("total_elements"),
        F.max(F.size(vector)).cast("bigint").alias("dimension"),
        (F.count("*") > 0).alias("is_trained"),
    ]
    return index.groupBy(by).agg(*measures) if by else index.agg(*measures)
