import os

import pytest
from pyspark.sql import functions as F

from corpusengine.operators.knn import knn, knn_by_section
from corpusengine.sources import chunks, corpus, index, topics
from tests.conftest import SF, rows

TOPIC_ROWS = [(1, "S001", "Prêts", "S001_T001", "Taux", "texte é", ["a", "b"])]


def test_topics_roundtrip(spark, tmp_path):
    df = spark.createDataFrame(TOPIC_ROWS, topics.TOPIC)
    topics.write_topics(df, str(tmp_path / "t"))
    parts = [f for f in os.listdir(tmp_path / "t") if f.endswith(".json")]
    assert any("Prêts" in (tmp_path / "t" / f).read_text(encoding="utf-8") for f in parts)
    assert rows(topics.read_topics(spark, str(tmp_path / "t"))) == rows(df)
    (tmp_path / "array.json").write_text('[{"topic_id": "x", "text": "y"},\n {"topic_id": "z"}]', encoding="utf-8")
    assert rows(topics.read_topics(spark, str(tmp_path / "array.json"), True), "topic_id") == [("x",), ("z",)]


def test_export_summary_of_nothing(spark):
    empty = spark.createDataFrame([], topics.TOPIC)
    assert tuple(topics.export_summary(empty, empty).first()) == ("failed", "No extractable text found", 0, 0)


def test_files(spark, tmp_path):
    for name, text in (("a.TXT", "one"), ("b.txt", "  "), ("c.md", "no")):
        (tmp_path / name).write_text(text)
    assert rows(corpus.text_files(spark, str(tmp_path)), "text") == [("one",)]
    assert corpus.file_listing(spark, str(tmp_path), "txt").count() == 2


def test_upsert_keeps_creation_time(spark):
    schema = "id BIGINT, text STRING, created_at STRING"
    target = spark.createDataFrame([(1, "a", "t1"), (2, "b", None)], schema)
    source = spark.createDataFrame([(2, None, "t9"), (3, "c", "t9")], schema)
    assert rows(chunks.upsert(target, source).na.fill("-")) == [(1, "a", "t1"), (2, "-", "-"), (3, "c", "t9")]


def test_index_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, "s", [1.0, 0.0]), (2, "t", [0.0, 1.0])], "id BIGINT, section STRING, embedding ARRAY<FLOAT>")
    folder = str(tmp_path / "index")
    assert index.load(spark, folder) is None
    index.save(df, folder)
    vectors, mark = index.load(spark, folder)
    assert mark == 2 and rows(vectors, "id", "section") == [(1, "s"), (2, "t")]
    query = spark.createDataFrame([(9, [1.0, 0.0])], "query_id BIGINT, embedding ARRAY<FLOAT>")
    assert rows(knn(query, vectors, 1, vec_id="id"), "vec_id") == [(1,)]
    assert sorted(chunks.chunks_after(vectors, mark).collect()) == []
    assert chunks.last_id(vectors.where("false")) == 0


def test_admin(spark):
    spark.range(1).write.mode("overwrite").saveAsTable("admin_probe")
    assert rows(chunks.describe(spark, "admin_probe"), "column", "type") == [("id", "bigint")]
    chunks.reset(spark, "admin_probe")
    assert not spark.catalog.tableExists("admin_probe")


def test_neutral_spans(spark):
    pages = spark.createDataFrame([(1, 1, "a\n\n b ")], "doc_id BIGINT, page_id INT, text STRING")
    assert rows(corpus.lines_to_spans(pages, "doc_id", "page_id", "text"), "pos", "text", "size") == [(0, "a", 12.0), (2, "b", 12.0)]


def test_spans_keep_all_visible_text(spark):
    html = "<div>top</div><p>one <b>two</b> three</p>bare<table><tr><td>cell</td><td>next</td></tr></table><h1>Head <i>line</i></h1><footer>end</footer>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<script>x</script>")], "page_id BIGINT, html STRING")
    sizes = {"h1": 18.0, "b": 14.0, "p": 11.0}
    got = [(r.text, r.size) for r in corpus.pages_to_spans(pages, sizes).orderBy("pos").collect()]
    assert got == [
        ("top", 10.0), ("one", 11.0), ("two", 14.0), ("three", 11.0), ("bare", 10.0), ("cell", 10.0), ("next", 10.0),
        ("Head line", 18.0), ("end", 10.0),
    ]
    listed = corpus.pages_to_spans(pages, sizes, default_size=None)
    assert rows(listed, "text") == [("Head line",), ("one",), ("three",), ("two",)]


def test_spans_of_the_given_pages_hold_their_visible_characters(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    spans = {r.doc_id: r.n for r in corpus.pages_to_spans(pages).groupBy("doc_id").agg(
        F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("n")).collect()}
    seen = {r.page_id: r.n for r in corpus.page_text(pages).select("page_id", F.length(F.regexp_replace("text", r"\s", "")).alias("n")).collect()}
    assert spans == seen


def test_vectors_of_other_lengths_and_large_ids(spark):
    vectors = spark.createDataFrame(
        [(1, "s", [1.0, 0.0, 5.0]), (2, "s", [3.0]), (3, "s", [0.0, 1.0]), (2**62 + 1, "t", [1.0, 1.0]), (5, "s", [None, 1.0])],
        "vec_id BIGINT, section STRING, embedding ARRAY<FLOAT>",
    )
    query = spark.createDataFrame([(2**62 + 3, [1.0, 1.0], ["s", "t"])], "query_id BIGINT, embedding ARRAY<FLOAT>, sections ARRAY<STRING>")
    assert rows(knn(query, vectors, 9), "vec_id", "score") == [(3, 1.0), (2**62 + 1, 0.0)]
    for legacy in (False, True):
        hits = knn_by_section(query, vectors, 9, legacy_order=legacy)
        assert {r[:2] for r in rows(hits, "query_id", "vec_id")} == {(2**62 + 3, 3), (2**62 + 3, 2**62 + 1)}
    mixed = query.unionByName(query.withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
    with pytest.raises(ValueError):
        knn(mixed, vectors, 1)
