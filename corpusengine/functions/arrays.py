"""Row-local array helpers that need no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and hand it to `body` as a bound variable."""
    return F.transform(F.array(value), body)[0]


def explode_rows(df: DataFrame, keep: list[str], array: Column, pos: str, value: str) -> DataFrame:
    """`keep`, the 0-based position and the element, one row per element of `array`.

    The outer form plus a filter on its position: the plain form makes the optimizer
    evaluate `array` a second time, as a filter on its size.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, value))
    return rows.where(F.col(pos).isNotNull())


def _run_starts(ordered: Column, key: Callable[[Column], Column]) -> Column:
    """0-based positions where the sorted array `ordered` begins a new key."""
    positions = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.filter(
        positions,
        lambda i: (i == 0) | (key(F.get(ordered, i)) != key(F.get(ordered, i - 1))),
    )


def term_counts(tokens: Column) -> Column:
    """`array<struct<term, tf>>` of a token array: sort, then measure the runs."""
    return let(
        F.sort_array(tokens),
        lambda s: let(
            _run_starts(s, lambda x: x),
            lambda st: F.transform(
                st,
                lambda p, j: F.struct(
                    F.get(s, p).alias("term"),
                    (F.coalesce(F.get(st, j + 1), F.size(s)) - p).alias("tf"),
                ),
            ),
        ),
    )


def most_frequent(words: Column, n: int) -> Column:
    """The `n` most frequent words, ties in order of first occurrence.

    Only counts are sorted for all words.  Places are looked up for the fewer than `n` words above the
    `n`-th count; the words with that count come in text order from an intersection.
    """
    none = F.array().cast("array<string>")

    def runs(s: Column) -> Column:
        return let(
            _run_starts(s, lambda x: x),
            lambda st: F.transform(
                st,
                lambda p, j: F.struct((p - F.coalesce(F.get(st, j + 1), F.size(s))).alias("neg_count"), F.get(s, p).alias("w")),
            ),
        )

    def ranked(ws: Column, counted: Column, cut: Column) -> Column:
        ties = F.transform(F.filter(counted, lambda r: r["neg_count"] == cut), lambda r: r["w"])
        above = F.transform(
            F.filter(counted, lambda r: r["neg_count"] < cut),
            lambda r: F.struct(r["neg_count"], F.array_position(ws, r["w"]).alias("first"), r["w"].alias("w")),
        )
        return let(
            F.sort_array(above),
            lambda top: F.concat(
                F.transform(top, lambda r: r["w"]),
                F.slice(F.array_intersect(ws, ties), F.lit(1), F.greatest(F.lit(n) - F.size(top), F.lit(0))),
            ),
        )

    def picked(ws: Column) -> Column:
        return let(
            let(F.sort_array(ws), runs),
            lambda counted: let(
                # With fewer than `n` words all of them stand above.
                F.coalesce(F.get(F.sort_array(F.transform(counted, lambda r: r["neg_count"])), F.lit(n - 1)), F.lit(0)),
                lambda cut: F.slice(ranked(ws, counted, cut), 1, n),
            ),
        )

    return let(F.coalesce(words, none), picked)


def first_occurrences(values: Column) -> Column:
    """`array<struct<v, at>>`: every distinct value with its first 0-based position."""
    placed = F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("at")))
    return let(
        F.sort_array(placed),
        lambda s: F.transform(_run_starts(s, lambda x: x["v"]), lambda p: F.get(s, p)),
    )
