"""What the training-data operators share: row ids, ASCII text rules, hash digests."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters `[\x20\x09-\x0D]`.
SPACES = " \t\n\x0b\x0c\r"
#: Names of helper columns start so, that columns of the input never clash with them.
ROW = "__llm_row"
#: How many splits a scan should have at least; unset, Spark takes the cores it has at that time.
SPLITS = "spark.sql.files.minPartitionNum"


def col(name: str) -> Column:
    """The column of exactly this name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all other letters as they are."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def numbered(docs: DataFrame, *columns: Column) -> DataFrame:
    """`columns` of every row and a number for the row in `ROW`.

    The number is the row's place in the scan, so it is the same each time a *table* is
    read; what is not a plain scan has to be written first.  It keeps rows with the same or
    no `doc_id` apart, as each row counts as a document of its own.  `columns` hold no
    generator: rows would be numbered after it.

    Splits of small tables depend on the number of cores, which moves with dynamic allocation.
    Where `spark.sql.files.minPartitionNum` is unset, it is set for the session to the number it
    stands for now, so that later readings are split alike.  `spark.sql.files.maxPartitionBytes` and
    `openCostInBytes` must stay while an operator runs.
    """
    spark = docs.sparkSession
    if spark.conf.get(SPLITS, None) is None:
        spark.conf.set(SPLITS, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism)
    return docs.select(F.monotonically_increasing_id().alias(ROW), *columns)


def digest(c: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(c))


def replaced(docs: DataFrame, text: str, value: Column, size: str = "n_chars") -> list[Column]:
    """All columns of `docs` with `value` as the text and its length in `size`, if there is such a column."""
    kinds = dict(docs.dtypes)
    return [
        value.alias(c) if c == text else F.length(value).cast(kinds[c]).alias(c) if c == size else col(c)
        for c in docs.columns
    ]
