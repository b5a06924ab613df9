"""Session construction and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Up to this size, as text, a side travels to the executors; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
# A side that is only read, filtered and reduced is known to be small from the size of its files.
SCANNED_BYTES = 2 << 20
# Up to so many keys reach a scan as a filter; beyond it a semi-join selects the rows.
PUSHED_KEYS = 1000

_local_scratch: tempfile.TemporaryDirectory | None = None


def build_session(app: str = "corpusengine", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; `conf` keys use `_` for `.`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("_", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local-mode session may
    fall back to a temporary folder, because there one machine is the whole cluster.
    """
    global _local_scratch
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    if _local_scratch is None:
        _local_scratch = tempfile.TemporaryDirectory(prefix="corpusengine-")
    return _local_scratch.name


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, cutting its lineage.

    Unlike a cached block the written table survives the loss of executors, and
    readers keep column pruning, filter pushdown and a known size in bytes.
    """
    path = f"{shared_dir(df.sparkSession)}/corpusengine/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many partitions as there are task slots.

    For scans that come in fewer (one unsplittable file, say); a scan of a large table has
    more and is left alone.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def small_side(df: DataFrame, limit_rows: int = BROADCAST_ROWS, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df` marked for broadcast if it is measured to be small, else left to a shuffle join.

    The measurement stops at the row limit, so it stays cheap for large inputs; what comes from
    small files without joins or generators needs none.
    """
    scanned = _scanned_bytes(df)
    if scanned is not None and scanned <= min(SCANNED_BYTES, limit_bytes) and limit_rows >= BROADCAST_ROWS:
        return F.broadcast(df)
    width = F.octet_length(F.to_json(F.struct(*df.columns)))
    size = df.limit(limit_rows + 1).agg(F.count("*").alias("n"), F.sum(width).alias("bytes")).first()
    return F.broadcast(df) if size["n"] <= limit_rows and (size["bytes"] or 0) <= limit_bytes else df


def _scanned_bytes(df: DataFrame) -> int | None:
    """Bytes that `df` reads, by the optimizer's estimate; None where it may make more of them or they are not known."""
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = re.findall(r"^[\s:+\-]*'?(\w+)", plan.toString(), re.MULTILINE)
    if not set(nodes) <= {"Project", "Filter", "Aggregate", "Relation", "LocalRelation", "Distinct"}:
        return None
    return int(str(plan.stats().sizeInBytes()))


def among(df: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """Rows of `df` whose `key` is in the one column of `asked`, which holds distinct values.

    A few keys become a filter that prunes the partitions and row groups of a stored table.
    """
    keys = [r[0] for r in asked.limit(PUSHED_KEYS + 1).collect()]
    if len(keys) <= PUSHED_KEYS:
        return df.where(F.col(key).isin(keys))
    return df.join(asked.toDF("_asked"), F.col(key) == F.col("_asked"), "left_semi")
