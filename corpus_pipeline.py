"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, and encoding.

Every stage takes `(spark, docs, sf_dir)` with the documents its predecessor kept and returns the
next ones; `docs` is a table that has been written.  A null text counts as empty everywhere, a null
`doc_id` is one like any other, rows with the same `doc_id` are documents of their own, further columns pass
through, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusengine.llm import line_dedup, line_quality, mixing, order_minhash, piece_codec
from corpusengine.session import materialize

#: A vocabulary file; its path is a parameter of the codec.
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail are gone, documents that fail too; empty texts have too few words and fail."""
    return line_quality.clean(docs)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents share are gone from all of them; a document left without a line stays, as an empty text."""
    return line_dedup.clean(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one of least `doc_id`; texts without a word have no copies."""
    return order_minhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, at most twice in total; every document stays, empty ones too."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and their decoded form, beside the document's id, language and source; an empty text has begin and end only."""
    return piece_codec.encoded(docs, MODEL, keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_shared_lines),
    ("near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Alignment and subword encoding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
