"""Dense numbering and running counts without gathering a table or a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusengine.session import materialize

_ROW_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in the low 33 bits


def with_dense_id(
    df: DataFrame, order: list[str], name: str = "id", partitions: int | None = None, costly: bool = False
) -> DataFrame:
    """Number the rows 1..N in the total order of the columns `order`.

    Range partitions are numbered locally and shifted by the row counts of the partitions
    before them; only that table of counts, one row per partition, is broadcast.  The
    placed rows are written once, so both uses see the same partition bounds.

    Finding the bounds reads the input once more; `costly` input is written first, so that it
    is computed only once.
    """
    if costly:
        df = materialize(df, "unnumbered")
    # Without a fixed number of partitions AQE merges small neighbours, which keeps the order.
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = (
        ranged
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
    )
    placed = materialize(placed, "dense-id")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return (
        placed.join(F.broadcast(shifts), "_part")
        .withColumn(name, F.col("_shift") + F.col("_at") + 1)
        .drop("_part", "_at", "_shift")
    )


def with_sequence(df: DataFrame, keys: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """Number the rows of every key 1..n in `order`; a hot key spans many tasks."""
    numbered = with_dense_id(df, [*keys, *order], "_dense")
    # One row per key, broadcast by adaptive execution if it turns out to be small.
    firsts = numbered.groupBy(*keys).agg(F.min("_dense").alias("_first"))
    return (
        numbered.join(firsts, keys)
        .withColumn(name, F.col("_dense") - F.col("_first") + 1)
        .drop("_dense", "_first")
    )


def with_running_counts(
    df: DataFrame, key: str, pos: str, flags: dict[str, Column], block: int = 4096
) -> DataFrame:
    """Running count of every flag per `key` in the order of the integer column `pos`.

    Two levels: counts inside blocks of `block` positions, plus the totals of the earlier
    blocks of the key.  A key of any length is spread over its blocks.
    """
    blocks = df.select(
        "*", *[c.cast("bigint").alias(f"_{n}") for n, c in flags.items()],
        F.floor(F.col(pos) / block).alias("_block"),
    )
    earlier = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = blocks.groupBy(key, "_block").agg(*[F.sum(f"_{n}").alias(f"_t_{n}") for n in flags])
    bases = totals.select(
        key, "_block", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in flags]
    )
    inside = W.partitionBy(key, "_block").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    counted = blocks.join(bases, [key, "_block"]).select(
        *df.columns,
        *[(F.sum(f"_{n}").over(inside) + F.col(f"_b_{n}")).alias(n) for n in flags],
    )
    return counted
