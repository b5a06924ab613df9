"""Trace roll-up and stage latency over stage events `(trace_id, event_id, ts, stage, seconds)`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusengine.operators.sequences import with_sequence


def rollup(events: DataFrame, part_lines: int = 500) -> DataFrame:
    """Ordered log lines per trace, in parts of at most `part_lines` lines `(trace_id, part, lines)`."""
    numbered = with_sequence(events.select("trace_id", "ts", "event_id", "line"), ["trace_id"], ["ts", "event_id"], "line_no")
    parts = numbered.groupBy("trace_id", (F.floor((F.col("line_no") - 1) / part_lines) + 1).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("rows")
    )
    return parts.select("trace_id", "part", F.transform("rows", lambda r: r["line"]).alias("lines"))


def stage_latency(events: DataFrame, failed: Column | None = None, q: float = 0.95) -> DataFrame:
    """Count, mean, maximum, interpolated `q` quantile and failures per stage.

    The quantile is read off the rows at its ranks, so no stage's values are collected.
    """
    failed = F.col("seconds").isNull() if failed is None else failed
    timed = events.where("seconds IS NOT NULL").select("stage", "seconds", "event_id")
    ranked = with_sequence(timed, ["stage"], ["seconds", "event_id"], "r")
    totals = events.groupBy("stage").agg(
        F.count("seconds").alias("n"),
        F.avg("seconds").alias("mean_seconds"),
        F.max("seconds").alias("max_seconds"),
        F.count_if(failed).alias("n_failed"),
    )
    at = (F.col("n") - 1) * q
    low = F.floor(at)
    near = (
        ranked.join(totals.select("stage", "n"), "stage")
        .where((F.col("r") - 1).between(low, low + 1))
        .groupBy("stage")
        .agg(
            F.max(F.when(F.col("r") - 1 == low, F.col("seconds"))).alias("lo"),
            F.max(F.when(F.col("r") - 1 == low + 1, F.col("seconds"))).alias("hi"),
        )
    )
    return totals.join(near, "stage", "left").select(
        "stage",
        "n",
        "mean_seconds",
        "max_seconds",
        (F.col("lo") + (F.coalesce("hi", "lo") - F.col("lo")) * (at - low)).alias("q_seconds"),
        "n_failed",
    )
