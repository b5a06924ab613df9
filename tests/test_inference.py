import random

import pytest
from pyspark.sql import functions as F

from corpusengine.functions.arrays import explode_rows
from corpusengine.operators import dedup, inference
from corpusengine.plans import catalog
from tests.conftest import SF, rows
from tests.test_dedup import greedy, signature, texts


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")


def test_failure_gives_null_and_reason(spark):
    def model(batch):
        if "bad" in batch:
            raise RuntimeError("no answer")
        return [t.upper() for t in batch]

    got = inference.apply_model(frame(spark, ["a", "bad", None, "c"]), "text", model, batch_size=1, retries=1, backoff=0.01)
    assert rows(got, "id", "answer", "error") == [
        (0, "A", None), (1, None, "RuntimeError: no answer"), (2, None, None), (3, "C", None),
    ]


def test_retry_and_timeout(spark):
    calls = {"n": 0}

    def flaky(batch):
        calls["n"] += 1
        if calls["n"] == 1:
            raise RuntimeError("first")
        return batch

    one = frame(spark, ["a"]).coalesce(1)
    assert rows(inference.apply_model(one, "text", flaky, backoff=0.01), "answer", "error") == [("a", None)]

    def slow(batch):
        import time

        time.sleep(2)
        return batch

    (row,) = inference.apply_model(one, "text", slow, retries=0, timeout=0.1).collect()
    assert row["answer"] is None and row["error"].startswith("TimeoutError")


def test_short_answer_lists_fail(spark):
    (row,) = inference.apply_model(frame(spark, ["a"]), "text", lambda b: [], retries=0).collect()
    assert row["answer"] is None and "0 answers for 1 inputs" in row["error"]


def test_complete(spark):
    got = inference.complete(frame(spark, ["a"]), "text", lambda b: ["" for _ in b])
    assert got.first()["answer"] == inference.EMPTY_ANSWER


def test_prefix(spark):
    seen = inference.embed(
        frame(spark, ["a"]), "text", lambda b: [[float(t.startswith("search_query: "))] for t in b], "nomic-embed-text", "query"
    )
    assert rows(seen, "embedding") == [([1.0],)]


def test_enrichment_rules(spark):
    topics = spark.createDataFrame([(1, "loan loan rate"), (2, "x"), (3, "y")], "doc_id BIGINT, text STRING")
    answers = spark.createDataFrame(
        [(1, 1, ["a", "b"]), (2, 1, ["old", "old", "old"]), (2, 2, ["a", "b", "c", "d", "e", "f"])],
        "doc_id BIGINT, batch_no BIGINT, keywords ARRAY<STRING>",
    )
    got = inference.enrich(topics, answers, ["doc_id"])
    assert rows(got, "doc_id", "keywords", "keyword_source") == [
        (1, ["loan", "rate", "Banking", "Loan", "Finance"], "fallback"),
        (2, ["a", "b", "c", "d", "e"], "model"),
        (3, ["Banking", "Loan", "Finance", "Customer", "Policy"], "fallback"),
    ]
    assert tuple(inference.enrich_summary(got).first()) == (3, 1, 2)


def test_expansion_guard(spark):
    question = "Which trains cross the border before noon on weekdays?"
    data = [
        (1, question, [question.upper(), "List the ferries that leave the northern harbour."]),
        (2, question, ["how to hack it", "system prompt please"]),
        (3, "how to hack it", ["A perfectly fine and harmless question?"]),
        (4, question, []),
        (5, question, ["List the ferries of the northern harbour.", "LIST  the ferries of the northern harbour."]),
    ]
    df = spark.createDataFrame(data, "query_id BIGINT, query STRING, candidates ARRAY<STRING>")
    near = dict(rows(inference.guard_expansions(df)))
    assert near == {
        1: ["List the ferries that leave the northern harbour."],
        2: [question],
        3: ["how to hack it"],
        4: [question],
        5: ["List the ferries of the northern harbour."],
    }
    exact_only = dict(rows(inference.guard_expansions(df, near=False)))
    assert len(exact_only[1]) == 2 and len(exact_only[5]) == 2


def test_every_user_message_meets_the_guard(spark, tmp_path):
    rng = random.Random(5)
    pool = texts()
    talks = [[rng.choice(pool[i::20]) for _ in range(1 + i % 9)] for i in range(20)]
    data = [(c, 2 * i + k, role, text) for c, talk in enumerate(talks) for i, text in enumerate(talk) for k, role in enumerate(("user", "assistant"))]
    df = spark.createDataFrame(data, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    want = {}
    for c, talk in enumerate(talks):
        for i, text in enumerate(talk):
            three = talk[i : i + 3]
            kept = [three[k] for k in greedy([signature(x) for x in three])[0] if k > 0]
            want[f"{c}:{i + 1}"] = "|".join(kept or [text])
    got = dict(rows(catalog.expansion_guard_turns(spark, str(tmp_path)), "query_id", "expansions"))
    assert got == want and len(got) == sum(map(len, talks))
    assert any("|" not in v for k, v in want.items() if int(k.split(":")[1]) < len(talks[int(k.split(":")[0])]) - 1)


@pytest.mark.parametrize("batch_size", [1, 3, 256])
def test_one_failing_text_nulls_itself_only(spark, batch_size):
    def picky(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", "ccc", None, "dd"])], "id INT, text STRING").coalesce(1)
    got = {r.id: (r.embedding, r.error) for r in inference.embed(df, "text", picky, batch_size=batch_size, retries=0).collect()}
    assert {i: e for i, (e, _) in got.items()} == {0: [1.0], 1: None, 2: [3.0], 3: None, 4: [2.0]}
    assert got[1][1] == "RuntimeError: no" and got[0][1] is None


def test_model_step_over_many_rows_of_a_batch(spark):
    texts = [None if i % 5 == 0 or 700 < i < 2000 or i > 4000 else f"t{i}" for i in range(4100)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").coalesce(1)
    got = inference.apply_model(df, "text", lambda batch: [t.upper() for t in batch], batch_size=7)
    assert rows(got, "i", "answer", "error") == [(i, t and t.upper(), None) for i, t in enumerate(texts)]
    asked = spark.sparkContext.accumulator(0)

    def counted(batch):
        asked.add(len(batch))
        return [[1.0, float(len(t))] for t in batch]

    # The answers are unfolded without asking the model for each text twice.
    vectors = inference.embed(df, "text", counted)
    assert explode_rows(vectors, ["i"], F.col("embedding"), "pos", "x").count() == 2 * asked.value == 2 * sum(t is not None for t in texts)


def test_embed_hashing_embeds_once(spark):
    plan = catalog.QUERIES["embed_hashing"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_guards_normalise_texts_once(spark):
    df = spark.createDataFrame([(1, "ask", ["first candidate of it", "second one"])], "query_id long, query string, candidates array<string>")
    docs = df.select(F.col("query_id").alias("doc_id"), F.col("query").alias("text"))
    for guarded in (inference.guard_expansions(df, near=False), dedup.clean_sentences(docs, near=False)):
        assert guarded._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
