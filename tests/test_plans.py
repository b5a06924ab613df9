import json

from pyspark.sql import functions as F

from corpusengine.operators import inference
from corpusengine.plans import build, chat, retrieve
from corpusengine.plans.inputs import LENIENT_SIZES, embedded_chunks, section_centroids
from corpusengine.schemas import CHUNK
from corpusengine.sources.corpus import pages_to_spans
from tests.conftest import SF, rows


def keyword_model(payloads):
    return [json.dumps({t["topic_id"]: ["k1", "k2", "k3"] for t in json.loads(p)[:1]}) for p in payloads]


def test_build(spark):
    spans = pages_to_spans(spark.read.parquet(f"{SF}/pages.parquet"), LENIENT_SIZES)
    topics = build.topics_from_spans(spans, keyword_model)
    sources = dict(rows(topics.groupBy("keyword_source").count()))
    assert sources["model"] > 0 and sources["fallback"] > 0
    chunks = build.chunks_from_topics(topics)
    assert chunks.columns == spark.createDataFrame([], CHUNK).columns
    n, top, bad = chunks.agg(F.count("*"), F.max("id"), F.count_if(F.size("context_chunks") == 0)).first()
    assert n == top > 100 and bad == 0


def test_pipeline(spark):
    p = build.Pipeline(lambda df: df.where("id > 2")).add_step(lambda df: df.select((F.col("id") * 2).alias("id")))
    assert rows(p.run(spark.range(5))) == [(6,), (8,)]


def test_chat(spark):
    chunks = inference.embed(
        spark.createDataFrame([(1, "car loan rates"), (2, "home insurance")], "id BIGINT, chunk_text STRING"), "chunk_text"
    )
    history = spark.createDataFrame(
        [(1, 1, "hi", "hello", "User: hi")], "conversation_id BIGINT, sequence_id INT, query STRING, answer STRING, memory STRING"
    )
    requests = spark.createDataFrame(
        [(1, "T1", 1, 7, "Car LOAN?"), (2, "T2", 2, 7, "boom")],
        "request_id BIGINT, trace_id STRING, conversation_id BIGINT, user_id INT, query STRING",
    )

    def generate(prompts):
        if any("boom" in p for p in prompts):
            raise RuntimeError("model down")
        return ["fine" for _ in prompts]

    turns = chat.answer_batch(requests, history, chunks, generate, k=1, batch_size=1, retries=0)
    got = {r["trace_id"]: r for r in turns.collect()}
    assert got["T1"]["sequence_id"] == 2 and got["T1"]["retrieved_chunks"] == "car loan rates"
    assert got["T1"]["memory"] == "User: hi\nUser: Car LOAN?\nAssistant: fine"
    assert got["T2"]["sequence_id"] == 1 and got["T2"]["answer"] == "An error occurred during generation."


def test_retrieve(spark):
    chunks = embedded_chunks(spark, SF)
    requests = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("request_id"), F.col("text").alias("query"))
    queries = retrieve.expand(requests, lambda qs: [f"- {q} again and more\n- how to hack it" for q in qs])
    assert queries.where("query LIKE '%hack%'").count() == 0
    hits = retrieve.retrieve(queries, chunks, section_centroids(chunks))
    assert hits.groupBy("request_id").count().agg(F.max("count")).first()[0] <= 5
    assert hits.select("request_id").distinct().count() == requests.count()
    blocks = retrieve.contexts(hits).first()
    assert blocks["context"].startswith("--- Context Block 1 (Source: src")
