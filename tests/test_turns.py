from pyspark.sql import functions as F

from corpusengine.schemas import TURN
from corpusengine.sources import turns
from tests.conftest import rows


def made(spark, ids, answer="a"):
    new = spark.createDataFrame(
        [(f"T{i}", f"c{i % 2}", 1, i, f"q{i}", answer if i % 3 else None) for i in ids],
        "trace_id string, conversation_id string, user_id int, sequence_id int, query string, answer string",
    )
    rollups = spark.createDataFrame([("T1", 2, ["c"]), ("T1", 1, ["a", "b"]), ("T9", 1, ["x"])], "trace_id string, part long, lines array<string>")
    return turns.complete_rows(new, rollups, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


def test_rows_are_complete(spark):
    got = made(spark, range(3))
    assert got.columns == spark.createDataFrame([], TURN).columns
    assert rows(got, "trace_id", "answer", "logs", "memory") == [
        ("T0", turns.ERROR_ANSWER, [], None), ("T1", "a", ["a", "b", "c"], None), ("T2", "a", [], None),
    ]


def test_a_batch_sent_again_takes_its_own_place(spark, tmp_path):
    path = str(tmp_path / "turns")
    turns.append_batch(made(spark, range(0, 3)), path, 0)
    turns.append_batch(made(spark, range(3, 5), "first try"), path, 1)
    turns.append_batch(made(spark, range(3, 6), "again"), path, 1)
    turns.append_batch(made(spark, []), path, 2)
    got = turns.read_turns(spark, path)
    assert got.columns == spark.createDataFrame([], TURN).columns
    assert rows(got, "trace_id", "answer") == [
        ("T0", turns.ERROR_ANSWER), ("T1", "a"), ("T2", "a"), ("T3", turns.ERROR_ANSWER), ("T4", "again"), ("T5", "again"),
    ]


def test_a_restarted_stream_appends_once(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(2):
        made(spark, [n]).write.mode("append").parquet(source)
    for checkpoint in ("one", "two"):  # a lost checkpoint starts from the first batch again
        stream = spark.readStream.schema(TURN).parquet(source).writeStream.option("checkpointLocation", str(tmp_path / checkpoint))
        stream.foreachBatch(turns.sink(path)).trigger(availableNow=True).start().awaitTermination(120)
    assert rows(turns.read_turns(spark, path), "trace_id") == [("T0",), ("T1",)]
