"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusengine.session import materialize


def components(links: DataFrame) -> DataFrame:
    """`(id, label)`: the least id of the component of every end of a link `(a, b)`.

    Each round takes the least label among neighbours and then that label's own label, so the
    number of rounds grows with the logarithm of a chain's length.  Labels are written between rounds.
    """
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other"))
    both = materialize(both.unionByName(both.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct(), "links")
    labels = both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("label"))
    labels = materialize(labels, "labels")
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("other"), "label"), "other")
            .groupBy("id")
            .agg(F.min("label").alias("near"))
        )
        low = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("low"))
        above = labels.select(F.col("id").alias("low"), F.col("label").alias("high"))
        # A label is itself an end of a link, so it has a label of its own.
        moved = low.join(above, "low").select("id", F.least("low", "high").alias("new"), "label")
        moved = materialize(moved, "labels")
        labels = moved.select("id", F.col("new").alias("label"))
        if moved.where("new < label").isEmpty():
            return labels
