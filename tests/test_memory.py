from pyspark.sql import functions as F

from corpusengine.operators import memory, prompts, trace
from corpusengine.sources import turns as turn_table
from tests.conftest import rows

TURNS = "conversation_id BIGINT, sequence_id INT, query STRING, answer STRING, memory STRING"


def turns(spark):
    return spark.createDataFrame(
        [(1, 1, "q1", "a1", "m1"), (1, 2, "q2", "a2", "m2"), (1, 3, "q3", "a3", "m3"), (1, 4, "q4", None, None), (2, 1, "x", "y", "m")],
        TURNS,
    )


def test_short_term(spark):
    got = dict(rows(memory.short_term(turns(spark))))
    assert got[1] == "User: q2\nAssistant: a2\nUser: q3\nAssistant: a3\nUser: q4\nAssistant: None"


def test_long_term_and_sequence(spark):
    assert rows(memory.long_term(turns(spark))) == [(1, ""), (2, "m")]
    assert rows(memory.next_sequence(turns(spark))) == [(1, 5), (2, 2)]


def test_tail_equals_tail_of_everything(spark):
    data = [(1, i, "q" * (i % 3), "a" * (i % 2), None) for i in range(1, 400)]
    df = spark.createDataFrame(data, TURNS)
    everything = "\n".join(f"User: {q}\nAssistant: {a}" for _, _, q, a, _ in data)
    assert memory.memory_tail(df).first()["memory"] == everything[-1000:]


def test_ownership(spark):
    conversations = spark.createDataFrame([(1, 7), (2, 8)], "id BIGINT, user_id INT")
    assert memory.owned(turns(spark), conversations, 7).count() == 4
    requests = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "conversation_id BIGINT, user_id INT")
    assert rows(memory.access_status(requests, conversations), "conversation_id", "status") == [(1, 200), (2, 403), (3, 404)]


def test_error_answer(spark):
    got = rows(turn_table.with_error_answer(turns(spark)).where("sequence_id = 4"), "answer")
    assert got == [("An error occurred during generation.",)]


def test_prompt_defaults(spark):
    hits = spark.createDataFrame([(1, 1, "vector", "t1"), (1, 2, "context_prev", "t2"), (2, 1, None, "t3")], "query_id BIGINT, position INT, retrieval_source STRING, text STRING")
    assert rows(prompts.prompt_parts(hits)) == [
        (1, "[VECTOR] t1", "[CONTEXT_PREV] t2"),
        (2, "[UNKNOWN] t3", "No extra context."),
    ]
    queries = spark.createDataFrame([(3, "q", None, None)], "query_id BIGINT, query STRING, ltm STRING, stm STRING")
    prompt = prompts.answer_prompts(queries, prompts.prompt_parts(hits)).first()["prompt"]
    assert "No direct data." in prompt and "No extra context." in prompt


def test_blocks(spark):
    hits = spark.createDataFrame([(1, 2, None, "b"), (1, 1, "s", "a")], "query_id BIGINT, rank INT, section STRING, text STRING")
    assert rows(prompts.context_blocks(hits)) == [
        (1, "--- Context Block 1 (Source: s) ---\na\n\n--- Context Block 2 (Source: General) ---\nb")
    ]
    assert rows(prompts.doc_blocks(hits)) == [(1, "[Doc 1]\na\n\n[Doc 2]\nb")]


def test_trace_parts(spark):
    events = spark.range(25).select(
        F.lit(1).alias("trace_id"), F.col("id").alias("event_id"), F.col("id").cast("timestamp").alias("ts"), F.col("id").cast("string").alias("line")
    )
    got = rows(trace.rollup(events, 10), "part", "lines")
    assert [len(lines) for _, lines in got] == [10, 10, 5]
    assert [line for _, lines in got for line in lines] == [str(i) for i in range(25)]


def test_latency_quantile(spark):
    events = spark.range(101).select(
        F.lit("s").alias("stage"), F.col("id").alias("event_id"), F.col("id").cast("double").alias("seconds")
    ).unionByName(spark.createDataFrame([("s", 200, None), ("t", 201, 4.0)], "stage STRING, event_id BIGINT, seconds DOUBLE"))
    got = rows(trace.stage_latency(events), "stage", "n", "max_seconds", "q_seconds", "n_failed")
    assert got == [("s", 101, 100.0, 95.0, 1), ("t", 1, 4.0, 4.0, 0)]
