import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

from corpusengine.operators import sequences, structure

LONG = "L" * 100
SPANS = [
    (1, 10.0, "intro"),
    (2, 14.0, "Overview"),
    (3, 10.0, "a"),
    (4, 18.0, "Car Loan"),
    (5, 10.0, "orphan"),
    (6, 14.0, "Rates"),
    (7, 10.0, "b"),
    (8, 14.0, LONG),
]


def spans(spark, items=SPANS):
    return spark.createDataFrame([(1, p, t, s) for p, s, t in items], "doc_id BIGINT, pos BIGINT, text STRING, size DOUBLE")


COLUMNS = ("topic_id", "section_name", "topic_name", "text")


def test_lenient(spark):
    assert rows(structure.hierarchy(spans(spark)), *COLUMNS) == [
        ("S001_T001", "Header", "Overview", "a orphan"),
        ("S002_T001", "Car Loan", "Rates", f"b {LONG}"),
    ]


def test_strict(spark):
    strict = structure.hierarchy(spans(spark), "drop", implicit_header=False, max_header_len=None)
    assert rows(strict, *COLUMNS) == [
        ("S001_T001", "Car Loan", "Rates", "b"),
        ("S001_T002", "Car Loan", LONG, ""),
    ]
    (section,) = structure.nested(strict).collect()
    assert [t["topic_id"] for t in section["topics"]] == ["S001_T001", "S001_T002"]


def test_one_size(spark):
    flat = spans(spark, [(1, 10.0, "a"), (2, 10.0, "b")])
    assert structure.hierarchy(flat).count() == 0
    assert structure.hierarchy(flat, min_sizes=2).count() == 0


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_running_counts_do_not_depend_on_blocks(spark, block):
    df = spark.range(50).select(F.lit(1).alias("k"), F.col("id").alias("pos"))
    counted = sequences.with_running_counts(df, "k", "pos", {"c": F.col("pos") % 3 == 0}, block)
    assert rows(counted, "pos", "c") == [(p, p // 3 + 1) for p in range(50)]


def test_dense_ids_and_sequences(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 3).alias("k")).repartition(5)
    ids = sequences.with_dense_id(df, ["x"], "id", 6)
    assert rows(ids, "id", "x") == [(i + 1, i) for i in range(1000)]
    # one key holds almost all rows
    skewed = df.withColumn("k", F.when(F.col("x") < 990, 0).otherwise(1))
    seq = rows(sequences.with_sequence(skewed, ["k"], ["x"]), "k", "x", "seq")
    assert seq == [(0, x, x + 1) for x in range(990)] + [(1, x, x - 989) for x in range(990, 1000)]
