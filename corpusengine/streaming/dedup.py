"""Deduplication whose registry outlives a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpusengine.operators.dedup import (
    MIN_LEN,
    THRESHOLD,
    band_buckets,
    exact,
    near_duplicates,
    signatures,
)
from corpusengine.operators.sequences import with_dense_id
from corpusengine.session import materialize
from corpusengine.streaming import registry


def exact_stream(texts: DataFrame, text: str, min_len: int = MIN_LEN, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Streaming texts without exact repeats; texts shorter than `min_len` all pass.

    State is one hash per distinct long text; short texts pass around it.  With `event_time` the state is dropped
    after `delay`, which bounds it and lets older repeats pass.
    """
    free = F.coalesce(F.length(text) < min_len, F.lit(False))
    keyed = texts.where(~free).withColumn("_key", F.sha2(text, 256))
    if event_time is None:
        firsts = keyed.dropDuplicates(["_key"])
    else:
        firsts = keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_key"])
    return firsts.drop("_key").unionByName(texts.where(free))


def near_batch(
    batch: DataFrame,
    batch_id: int,
    folder: str,
    output: str,
    text: str = "text",
    order: tuple[str, ...] = ("doc_id", "pos"),
    threshold: float = THRESHOLD,
    perms: int = 64,
    fan: int = registry.FAN,
) -> None:
    """Write the texts of a batch that repeat no earlier kept text to `output`, and register them in `folder`."""
    spark = batch.sparkSession
    fresh = exact(batch, text, list(order))
    rows = materialize(signatures(with_dense_id(fresh, list(order), "_n"), text, perms), "stream-batch")
    free = (F.length(text) < MIN_LEN) | F.col("signature").isNull()
    long = rows.where(~free).withColumn("id", registry.batch_id(batch_id, F.col("_n")))
    runs = registry.runs_before(spark, folder, batch_id)
    items = long.select("id", "signature")
    earlier = registry.related(spark, folder, runs, band_buckets(items, perms, threshold))
    both = materialize(items.unionByName(earlier), "stream-signatures")
    gone = near_duplicates(both, perms, threshold).select("id")
    kept = materialize(long.select("id", "_n", "signature").join(gone, "id", "left_anti"), "stream-kept")
    passed = rows.where(free).unionByName(rows.join(kept.select("_n"), "_n", "left_semi").select(*rows.columns))
    passed.drop("_n", "signature").write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
    kept = kept.select("id", "signature")
    registry.add(spark, folder, batch_id, runs, kept, band_buckets(kept, perms, threshold).select("id", "bucket"), fan)


def near_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType | str,
    registry_folder: str,
    output: str,
    checkpoint: str,
    text: str = "text",
    order: tuple[str, ...] = ("doc_id", "pos"),
    threshold: float = THRESHOLD,
    perms: int = 64,
    max_files: int = 100,
) -> StreamingQuery:
    """Write the texts under `source` that repeat no earlier kept text, exactly or nearly.

    The `registry_folder` holds the kept texts' signatures and buckets (`streaming.registry`).  A batch meets only the
    registered texts that share a bucket with it; those come first in the order, so they
    stay and newcomers give way.  Registry and output have one folder per batch, overwritten
    on replay, and a batch reads only what the batches before it left.
    """
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)

    def add(batch: DataFrame, batch_id: int) -> None:
        near_batch(batch, batch_id, registry_folder, output, text, order, threshold, perms)

    return (
        new.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
