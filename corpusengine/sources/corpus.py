"""Document and page scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusengine.functions.arrays import explode_rows, let
from corpusengine.functions.text import collapse, is_blank, strip

# A tag's rank plays the part of the font size.
TAG_SIZES = {
    "h1": 18.0,
    "title": 14.0,
    "h2": 14.0,
    "h3": 13.0,
    "h4": 12.0,
    "h5": 11.5,
    "h6": 11.0,
    "p": 10.0,
    "li": 10.0,
}

#: Size of text in no listed tag.
BODY_SIZE = 10.0
#: Tags that divide text without a size of their own, and the mark they leave.
BLOCK_TAGS = (
    "address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main nav ol p pre section table tbody td tfoot th thead title tr ul"
).split()
BOUNDARY = "\x03"

NOT_TEXT = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
# Entities decoded, `&amp;` last.
ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&amp;", "&"),
)


def corpus(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of a Parquet corpus; null and blank texts are dropped."""
    table = spark.read.parquet(path)
    rest = [c for c in table.columns if c not in (id_col, text_col)]
    return without_blank(table.select(id_col, text_col, *rest), text_col)


def without_blank(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.where(~is_blank(F.col(text_col)))


def file_listing(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """Path, size and modification time of the files with `suffix` in any letter case."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(folder)
        .select("path", "length", "modificationTime")
    )


def text_files(spark: SparkSession, folder: str, suffix: str = "txt") -> DataFrame:
    """One row per file with `suffix` in any letter case; blank files are dropped."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    files = (
        spark.read.option("wholetext", True)
        .option("pathGlobFilter", glob)
        .text(folder)
        .select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    )
    return without_blank(files)


def _decode(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def page_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """`html` reduced to its visible text in column `text`; blank pages are dropped."""
    visible = F.regexp_replace(F.regexp_replace(F.col(html), NOT_TEXT, " "), "<[^>]*>", " ")
    return without_blank(pages.withColumn("text", collapse(_decode(visible))).drop(html))


def _enclosing_sizes(parts: Column, tag_sizes: dict[str, float], default_size: float) -> Column:
    """The size that holds for each part: that of the innermost listed tag still open, else the default."""
    size = F.create_map(*[F.lit(v) for kv in tag_sizes.items() for v in kv])

    def step(state: Column, part: Column) -> Column:
        mark = F.substring_index(part, "\x02", 1)
        stack = (
            F.when(~part.contains("\x02") | (mark == BOUNDARY), state["stack"])
            .when(mark == "", F.slice(state["stack"], 1, F.greatest(F.size(state["stack"]) - 1, F.lit(0))))
            .otherwise(F.array_append(state["stack"], F.try_element_at(size, F.lower(mark))))
        )
        return let(
            stack,
            lambda s: F.struct(
                s.alias("stack"),
                F.array_append(
                    state["sizes"],
                    F.when(F.size(s) > 0, F.get(s, F.size(s) - 1)).otherwise(F.lit(default_size)),
                ).alias("sizes"),
            ),
        )

    none = F.array().cast("array<double>")
    return F.aggregate(parts, F.struct(none.alias("stack"), none.alias("sizes")), step)["sizes"]


def pages_to_spans(
    pages: DataFrame, tag_sizes: dict[str, float] = TAG_SIZES, doc_id: str = "page_id", html: str = "html",
    default_size: float | None = BODY_SIZE,
) -> DataFrame:
    """Reading-order spans `(doc_id, pos, text, size)` of HTML pages.

    Row-local: listed tags and block tags divide the page, the other tags vanish, the parts are
    exploded.  A part has the size of the innermost listed tag around it, so text after an inline
    tag returns to the tag before; text in no listed tag has `default_size`, and is dropped when that is None.
    """
    tags = "|".join(tag_sizes)
    blocks = "|".join(t for t in BLOCK_TAGS if t not in tag_sizes)
    marked = F.regexp_replace(F.col(html), NOT_TEXT, "")
    marked = F.regexp_replace(marked, rf"(?i)</({tags})>", "\x01\x02")
    marked = F.regexp_replace(marked, rf"(?i)<({tags})(\s[^>]*)?>", "\x01$1\x02")
    marked = F.regexp_replace(marked, rf"(?i)</?({blocks})(\s[^>]*)?>", f"\x01{BOUNDARY}\x02")
    marked = F.regexp_replace(F.regexp_replace(marked, r"(?i)<br\s*/?>", " "), "<[^>]*>", "")
    named = pages.withColumnRenamed(doc_id, "doc_id")
    # A default that no tag has marks the text to drop.
    outside = -1.0 if default_size is None else default_size
    sized = let(
        F.split(marked, "\x01"),
        lambda parts: F.zip_with(
            parts, _enclosing_sizes(parts, tag_sizes, outside), lambda p, s: F.struct(p.alias("part"), s.alias("size"))
        ),
    )
    rows = explode_rows(named, ["doc_id"], sized, "pos", "x")
    spans = rows.select(
        "doc_id",
        F.col("pos").cast("bigint").alias("pos"),
        strip(_decode(F.substring_index(F.col("x")["part"], "\x02", -1))).alias("text"),
        F.round(F.col("x")["size"], 1).alias("size"),
    )
    return spans.where((F.col("size") >= 0) & (F.col("text") != ""))


def lines_to_spans(pages: DataFrame, doc_id: str, page_id: str, text: str, size: float = 12.0) -> DataFrame:
    """Spans of plain page texts: one per non-blank line, all of one neutral size."""
    parts = pages.select(
        F.col(doc_id).alias("doc_id"),
        F.col(page_id).alias("page_id"),
        F.posexplode(F.split(text, "\n")).alias("line_no", "line"),
    )
    return parts.select(
        "doc_id", "page_id", F.col("line_no").cast("bigint").alias("pos"), strip(F.col("line")).alias("text"),
        F.lit(size).alias("size"),
    ).where(F.col("text") != "")
