"""Incremental index sync: a file stream of chunks into a Parquet index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpusengine.operators.ann import ivf_assign
from corpusengine.sources.chunks import embedded


def sync_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType | str,
    index: str,
    checkpoint: str,
    centres: DataFrame | None = None,
    max_files: int = 100,
    vector: str = "embedding",
) -> StreamingQuery:
    """Append every new chunk under `source` that carries a vector to `index`, then stop.

    The checkpoint remembers the files taken, so a restart adds only new ones.  With
    `centres` each vector gets its cell.  Each micro-batch owns one folder and overwrites
    it when replayed, so a failure between write and commit adds nothing twice.
    """
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)

    def add(batch: DataFrame, batch_id: int) -> None:
        rows = embedded(batch, vector)
        if centres is not None:
            rows = ivf_assign(rows, centres, vector)
        rows.write.mode("overwrite").parquet(f"{index}/sync_batch={batch_id}")

    return (
        new.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_index(spark: SparkSession, index: str, id_col: str = "id") -> DataFrame:
    """The index with the latest version of every id."""
    rows = spark.read.parquet(index)
    columns = [c for c in rows.columns if c not in (id_col, "sync_batch")]
    latest = rows.groupBy(id_col).agg(F.max_by(F.struct(*columns), "sync_batch").alias("_row"))
    return latest.select(id_col, "_row.*")


def watermark(spark: SparkSession, index: str, id_col: str = "id") -> int:
    """Highest id in the index, 0 when it is empty."""
    return spark.read.parquet(index).agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
