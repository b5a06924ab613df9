"""Section and topic recovery from sized spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusengine.operators.sequences import with_running_counts, with_sequence
from corpusengine.session import materialize


def size_histogram(spans: DataFrame) -> DataFrame:
    """Distinct sizes of every document, the section size and the topic size."""
    counts = spans.groupBy("doc_id", "size").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("doc_id").agg(
        F.sort_array(F.collect_list("size"), asc=False).alias("sizes"), F.sum("n").alias("n_spans")
    )
    return sizes.select(
        "doc_id",
        "sizes",
        "n_spans",
        F.get("sizes", F.lit(0)).alias("section_size"),
        F.coalesce(F.get("sizes", F.lit(1)), F.get("sizes", F.lit(0))).alias("topic_size"),
    )


def hierarchy(
    spans: DataFrame,
    orphan_policy: str = "attach",
    implicit_header: bool = True,
    max_header_len: int | None = 100,
    min_sizes: int = 1,
) -> DataFrame:
    """Topics `(doc_id, section_id, section_name, topic_id, topic_name, text)`.

    Spans of the largest size open sections, of the second largest topics; the others are
    body lines of the latest topic.  `implicit_header` starts in section S001 "Header";
    without it a topic needs an open section.  A body line after a new section header but
    before its first topic goes to the previous topic ("attach") or is lost ("drop").
    """
    if orphan_policy not in ("attach", "drop"):
        raise ValueError(f"orphan_policy {orphan_policy!r}")
    # Read several times below; written once so that span extraction runs once.
    spans = materialize(spans.select("doc_id", "pos", "text", "size"), "spans")
    sizes = (
        size_histogram(spans)
        .where(F.size("sizes") >= min_sizes)
        .select("doc_id", "section_size", "topic_size")
    )
    short = F.lit(True) if max_header_len is None else F.length("text") < max_header_len
    is_section = (F.col("size") == F.col("section_size")) & short
    is_topic = ~is_section & (F.col("size") == F.col("topic_size")) & short
    counted = with_running_counts(
        spans.join(sizes, "doc_id").select(
            "doc_id", "pos", "text", is_section.alias("is_section"), is_topic.alias("is_topic")
        ),
        "doc_id",
        "pos",
        {"sections": F.col("is_section"), "topics": F.col("is_topic")},
    )
    headers = counted.where("is_section").select(
        "doc_id", "sections", F.col("text").alias("section_name"), F.col("topics").alias("topics_before")
    )
    run = ["doc_id", "topics"] + (["sections"] if orphan_policy == "drop" else [])
    opened = F.max(F.when(F.col("is_topic"), F.col("sections")))
    runs = (
        counted.where("not is_section and topics > 0")
        .groupBy(*run)
        .agg(
            F.max(F.when(F.col("is_topic"), F.col("text"))).alias("topic_name"),
            opened.alias("_opened"),
            F.expr(
                "listagg(CASE WHEN NOT is_topic THEN text END, ' ') WITHIN GROUP (ORDER BY pos)"
            ).alias("text"),
        )
        .where("topic_name IS NOT NULL")
        .select("doc_id", "topics", F.col("_opened").alias("sections"), "topic_name", "text")
    )
    if not implicit_header:
        runs = runs.where("sections > 0")
    shift = 1 if implicit_header else 0
    section_id = F.format_string("S%03d", F.col("sections") + shift)
    topic_no = F.col("topics") - F.coalesce("topics_before", F.lit(0))
    return runs.join(headers, ["doc_id", "sections"], "left").select(
        "doc_id",
        section_id.alias("section_id"),
        F.coalesce("section_name", F.lit("Header")).alias("section_name"),
        F.concat(section_id, F.format_string("_T%03d", topic_no)).alias("topic_id"),
        "topic_name",
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("topics").alias("topic_seq"),
    )


def nested(topics: DataFrame) -> DataFrame:
    """One row per section with its topics as an array in topic order."""
    grouped = topics.groupBy("doc_id", "section_id", "section_name").agg(
        F.sort_array(F.collect_list(F.struct("topic_seq", "topic_id", "topic_name", "text"))).alias("topics")
    )
    return grouped.withColumn(
        "topics",
        F.transform("topics", lambda t: F.struct(t["topic_id"], t["topic_name"], t["text"])),
    )


def paragraph_numbers(topics: DataFrame, label: str = "paragraph_id") -> DataFrame:
    """Number the surviving topics of each document `P_001`, `P_002`, … in topic order."""
    numbered = with_sequence(topics, ["doc_id"], ["topic_seq"], "_n")
    return numbered.withColumn(label, F.format_string("P_%03d", F.col("_n"))).drop("_n")
