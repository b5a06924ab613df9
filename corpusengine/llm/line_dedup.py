"""Lines that many documents share are dropped from all of them.

Lines are exploded with their positions and hashed; the documents of each hash are counted;
the positions of frequent lines come back to their documents, whose texts are joined again
from the positions left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusengine.llm.common import ROW, SPACES, col, digest, lower_ascii, numbered, replaced, text_of
from corpusengine.session import materialize

MIN_DOCUMENTS = 10
MIN_CHARS = 1


def line_key(line: Column) -> Column:
    """The line without white space at its ends and A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def frequent_lines(docs: DataFrame, text: str = "text", min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS) -> DataFrame:
    """`(key, n_documents)` of the line digests found in at least `min_documents` rows.

    A line counts once in a document, so it reaches the shuffle as a count per task.
    """
    keys = F.array_distinct(
        F.transform(
            F.filter(F.transform(_lines(text_of(text)), line_key), lambda k: F.length(k) >= min_chars), digest
        )
    )
    return (
        docs.select(F.explode(keys).alias("key"))
        .groupBy("key")
        .agg(F.count("*").alias("n_documents"))
        .where(F.col("n_documents") >= min_documents)
    )


def dropped_positions(docs: DataFrame, text: str = "text", **limits: int) -> DataFrame:
    """`(ROW, dropped)`: the positions of frequent lines of the documents that have any.

    A line of a third of all documents is one key of the join; adaptive execution divides it,
    or broadcasts the frequent lines when it finds them to be small.  They are written first, so
    that both sides of the join can be dealt out anew.
    """
    placed = numbered(docs, text_of(text).alias("t")).select(ROW, F.posexplode(_lines(F.col("t"))).alias("at", "line"))
    placed = placed.select(ROW, "at", digest(line_key(F.col("line"))).alias("key"))
    frequent = materialize(frequent_lines(docs, text, **limits).select("key"), "frequent-lines")
    return placed.join(frequent, "key").groupBy(ROW).agg(F.collect_list("at").alias("dropped"))


def without_frequent_lines(docs: DataFrame, text: str = "text", **limits: int) -> DataFrame:
    """`(doc, n_lines, n_dropped, kept)` of every row; `doc` has its columns, `kept` the text left.

    `docs` is a table.  Each row is a document, also with a null or repeated `doc_id`; a null
    or empty text is one empty line, and empty lines are never dropped.
    """
    whole = numbered(docs, F.struct(*[col(c) for c in docs.columns]).alias("doc"), text_of(text).alias("t"))
    joined = whole.join(dropped_positions(docs, text, **limits), ROW, "left")
    split = joined.select("doc", _lines(F.col("t")).alias("lines"), "t", "dropped")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    return split.select(
        "doc",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped").cast("long"), F.lit(0)).alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("t"))
        .otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
        .alias("kept"),
    )


def clean(docs: DataFrame, text: str = "text", size: str = "n_chars", **limits: int) -> DataFrame:
    """All documents, with the columns of `docs` and their texts without frequent lines."""
    done = without_frequent_lines(docs, text, **limits)
    columns = replaced(docs, text, F.col("kept"), size)
    return done.select(
        *[c if n in (text, size) else F.col("doc")[n].alias(n) for n, c in zip(docs.columns, columns, strict=True)]
    )


def report(docs: DataFrame, text: str = "text", **limits: int) -> DataFrame:
    """`doc_id`, the line counts and the SHA-256 of the text left, for every row."""
    return without_frequent_lines(docs, text, **limits).select(
        F.col("doc")["doc_id"].alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )
