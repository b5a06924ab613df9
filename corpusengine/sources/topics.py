"""JSON exchange of enriched topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusengine.schemas import TOPIC


def write_topics(topics: DataFrame, path: str) -> None:
    """UTF-8 JSON lines; non-ASCII characters stay as they are."""
    topics.write.mode("overwrite").json(path)


def read_topics(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Topics with the contract schema; `multi_line` reads files that hold one JSON array."""
    return spark.read.schema(TOPIC).option("multiLine", multi_line).json(path)


def export_summary(topics: DataFrame, pages: DataFrame) -> DataFrame:
    """One-row status envelope of an export."""
    marks = pages.select(F.lit(1).alias("p"), F.lit(0).alias("t")).unionAll(
        topics.select(F.lit(0).alias("p"), F.lit(1).alias("t"))
    )
    totals = marks.agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("total_pages"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("total_topics"),
    )
    empty = F.col("total_pages") == 0
    return totals.select(
        F.when(empty, "failed").otherwise("success").alias("status"),
        F.when(empty, "No extractable text found").alias("reason"),
        "total_pages",
        "total_topics",
    )
