"""Units of text (words, chunks) counted over the corpus, and its frequent ones."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A task sends on its counts when it holds so many different units.
FLUSH = 200_000
#: A unit is frequent from this share of all units on, so there are at most 500,000 of them.
SHARE = 2e-6


def counted(docs: DataFrame, split: Callable[[bytes], Iterable[bytes]]) -> DataFrame:
    """`(unit, n, n_flagged)`: occurrences of every unit of the binary column `text`, and those in rows with `flag`.

    Tasks count what they read before the shuffle, so a unit of a third of all
    occurrences is a few rows of each task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {False: Counter(), True: Counter()}

        def flush() -> Iterator[pa.RecordBatch]:
            for flag, units in seen.items():
                if units:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(list(units), pa.binary()),
                            pa.array([flag] * len(units), pa.bool_()),
                            pa.array(list(units.values()), pa.int64()),
                        ],
                        ["unit", "flag", "n"],
                    )
                    units.clear()

        for batch in batches:
            for text, flag in zip(batch.column("text"), batch.column("flag").to_pylist(), strict=True):
                seen[flag].update(split(text.as_py()))
                if len(seen[False]) + len(seen[True]) > FLUSH:
                    yield from flush()
        yield from flush()

    return (
        docs.select("text", "flag")
        .mapInArrow(count, "unit binary, flag boolean, n long")
        .groupBy("unit")
        .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("flag"), F.col("n")).otherwise(0)).alias("n_flagged"))
    )


def frequent(units: DataFrame, share: float = SHARE) -> DataFrame:
    """The units with at least `share` of all occurrences; there are at most `1 / share`."""
    return units.where(F.col("n") >= threshold(units, share))


def threshold(units: DataFrame, share: float = SHARE) -> float:
    """Occurrences from which on a unit is frequent."""
    return max(2.0, share * (units.agg(F.sum("n")).first()[0] or 0))
