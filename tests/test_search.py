import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF, rows

from corpusengine.operators import ann, hybrid, knn, lexical
from corpusengine import session
from corpusengine.sources import index
from corpusengine.plans.inputs import labelled_vectors, vector_queries


@pytest.fixture(scope="module")
def vectors(spark):
    return labelled_vectors(spark, SF)


@pytest.fixture(scope="module")
def queries(spark):
    return vector_queries(spark, SF)


def table(df):
    return rows(df, "query_id", "rank", "vec_id", "score")


def brute(vectors, queries, k, within=False):
    v = sorted(vectors.collect(), key=lambda r: r["vec_id"])
    matrix = np.array([r["embedding"] for r in v], dtype=float)
    out = []
    for q in queries.collect():
        d = np.round(((matrix - np.array(q["embedding"], dtype=float)) ** 2).sum(1), 6)
        found = [(d[i], r["vec_id"]) for i, r in enumerate(v) if not within or r["section"] in q["sections"]]
        out += [(q["query_id"], n + 1, i) for n, (_, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("within", [False, True])
@pytest.mark.parametrize("how", ["broadcast", "grid"])
def test_exact(spark, vectors, queries, monkeypatch, within, how):
    monkeypatch.setattr(knn, "GRID_QUERIES", 100)
    monkeypatch.setattr(knn, "GRID_VECTORS", 150)
    some = queries.where("query_id < 150")
    got = knn.knn(
        some, vectors.repartition(5), 5, within=("sections", "section") if within else None,
        broadcast_bytes=1 << 30 if how == "broadcast" else 0,
    )
    assert [g[:3] for g in table(got)] == brute(vectors, some, 5, within)


def test_fewer_vectors_than_k_and_empty(spark, vectors, queries):
    few = vectors.where("vec_id < 3")
    assert knn.knn(queries, few, 5).count() == 3 * queries.count()
    assert knn.knn(queries, vectors.where("false"), 5).count() == 0
    assert knn.knn(queries.where("false"), vectors, 5).count() == 0


def test_null_and_empty_vectors_are_skipped(spark):
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [])], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    q = spark.createDataFrame([(9, [0.0, 1.0]), (8, None)], "query_id BIGINT, embedding ARRAY<FLOAT>")
    assert table(knn.knn(q, v)) == [(9, 1, 1, 0.0)]


def test_ties_go_to_the_smaller_id(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50, 0, -1)], "vec_id BIGINT, embedding ARRAY<FLOAT>").repartition(7)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id BIGINT, embedding ARRAY<FLOAT>")
    assert [g[2] for g in table(knn.knn(q, v, 4))] == [1, 2, 3, 4]


def test_ivf(spark, vectors, queries):
    centres = ann.ivf_train(vectors, 10)
    index = ann.ivf_assign(vectors, centres)
    exact = table(knn.knn(queries, vectors))
    assert table(ann.ivf_search(queries, index, centres, nprobe=10)) == exact
    truth = {(q, v) for q, _, v, _ in exact}
    recall = len(truth & {(q, v) for q, _, v, _ in table(ann.ivf_search(queries, index, centres, nprobe=8))}) / len(truth)
    assert recall >= 0.9
    with pytest.raises(ValueError):
        ann.ivf_train(vectors, 10_000)


def test_lsh_recall(spark, vectors, queries):
    index = ann.lsh_codes(vectors, 64, 3)
    truth = {(q, v) for q, _, v, _ in table(knn.knn(queries, vectors))}
    found = {(q, v) for q, _, v, _ in table(ann.lsh_search(queries, index, 64, bits=3))}
    assert len(truth & found) / len(truth) > 0.6


def test_lsh_tables(spark, vectors, queries):
    truth = {(q, v) for q, _, v, _ in table(knn.knn(queries, vectors))}
    index = ann.lsh_index(vectors, 64, tables=8, bits=4)
    hits = table(ann.lsh_tables_search(queries, index, 64, tables=8, bits=4))
    found = {(q, v) for q, _, v, _ in hits}
    assert len(found) == len(hits) and len(truth & found) / len(truth) >= 0.9


def test_lsh_tables_on_clusters_meet_few(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(40, 64))
    rows_ = [(i, (centres[i % 40] + 0.25 * draw.normal(size=64)).tolist()) for i in range(2000)]
    rows_ += [(5000, None), (5001, [1.0]), (5002, [None] * 64)]
    v = spark.createDataFrame(rows_, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    q = v.where("vec_id < 50").withColumnRenamed("vec_id", "query_id")
    index = ann.lsh_index(v, 64, tables=6, bits=8)
    truth = {(a, b) for a, _, b, _ in table(knn.knn(q, v))}
    found = {(a, b) for a, _, b, _ in table(ann.lsh_tables_search(q, index, 64, tables=6, bits=8))}
    assert len(truth & found) / len(truth) >= 0.9
    probes = ann.lsh_probes(q, 64, 6, 8, 2).select("query_id", F.explode("buckets").alias("bucket"))
    met = probes.join(index.select("vec_id", "bucket"), "bucket").select("query_id", "vec_id").distinct().count()
    assert met < 0.15 * 50 * 2000


def test_merge(spark):
    v = spark.createDataFrame([(1, 7, 0.1, 1), (1, 3, 0.2, 2)], "query_id BIGINT, chunk_id BIGINT, score DOUBLE, rank INT")
    b = spark.createDataFrame([(1, 3, 5.0, 1), (1, 9, 4.0, 2)], "query_id BIGINT, chunk_id BIGINT, score DOUBLE, rank INT")
    got = rows(hybrid.merge(v, b), "position", "chunk_id", "retrieval_source")
    assert got == [(1, 7, "vector"), (2, 3, "vector"), (3, 9, "bm25")]


@pytest.fixture(scope="module")
def tiny(spark):
    chunks = spark.createDataFrame(
        [(1, "a", "car loan rate", [1.0, 0.0]), (2, "a", "home loan", [0.9, 0.1]), (3, "b", "car car insurance", [0.0, 1.0]), (4, "c", "car loan", [1.0, 0.0])],
        "chunk_id BIGINT, section STRING, text STRING, embedding ARRAY<FLOAT>",
    )
    queries = spark.createDataFrame(
        [(1, "car insurance", ["a", "b", "a"], [1.0, 0.0]), (2, "car", ["none"], [1.0, 0.0])],
        "query_id BIGINT, query STRING, sections ARRAY<STRING>, embedding ARRAY<FLOAT>",
    )
    return queries, chunks


def okapi(corpus, query, k1=1.5, b=0.75, eps=0.25):
    docs = [c.lower().split() for c in corpus]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    vocab = {w for d in docs for w in d}
    idf = {w: np.log(n - (f := sum(w in d for d in docs)) + 0.5) - np.log(f + 0.5) for w in vocab}
    floor = eps * sum(idf.values()) / len(idf)
    idf = {w: floor if x < 0 else x for w, x in idf.items()}
    return [
        sum(idf.get(w, 0) * d.count(w) * (k1 + 1) / (d.count(w) + k1 * (1 - b + b * len(d) / avg)) for w in query.lower().split())
        for d in docs
    ]


def test_bm25_is_local_to_the_pool(spark, tiny):
    queries, chunks = tiny
    scores = okapi(["car loan rate", "home loan", "car car insurance"], "car insurance")
    want = sorted(((round(s, 6), i + 1) for i, s in enumerate(scores) if s > 0), key=lambda x: (-x[0], x[1]))
    got = rows(lexical.bm25(queries, chunks), "query_id", "rank", "score", "chunk_id")
    assert got == [(1, n + 1, s, i) for n, (s, i) in enumerate(want)]


def test_bm25_without_broadcast(spark, tiny, monkeypatch):
    queries, chunks = tiny
    want = rows(lexical.bm25(queries, chunks))
    monkeypatch.setattr(lexical, "small_side", lambda df: df)
    assert rows(lexical.bm25(queries, chunks)) == want


def test_pool_and_postfilter(spark, tiny):
    queries, chunks = tiny
    assert rows(hybrid.section_pool(queries, chunks)) == [(1, 2, 2, 3, 39), (2, 1, 0, 0, 0)]
    # the two nearest chunks of the corpus are 1 and 4; only 1 lies in the pool
    assert rows(hybrid.vector_hits(queries, chunks, 2, 1), "query_id", "chunk_id") == [(1, 1)]
    assert rows(hybrid.vector_hits(queries, chunks, 2, prefilter=True), "query_id", "chunk_id") == [(1, 1), (1, 2)]


def test_routes(spark, tiny):
    queries, _ = tiny
    sections = spark.createDataFrame([("x", [0.0, 1.0]), ("m", [1.0, 0.1]), ("b", [-1.0, 0.0])], "section STRING, embedding ARRAY<FLOAT>")
    one = queries.where("query_id = 1")
    assert rows(hybrid.route(one, sections), "sections") == [(["m", "x"],)]
    assert rows(hybrid.route(one, sections, threshold=0.55), "sections") == [(["m"],)]
    assert rows(hybrid.route(one, sections, threshold=0.999), "sections") == [(["b", "m"],)]
    picked = spark.createDataFrame([(1, ["q", "r", "s"])], "query_id BIGINT, picked ARRAY<STRING>")
    assert rows(hybrid.route(one, sections, answers=picked), "sections") == [(["q", "r"],)]


def test_unique_texts(spark):
    hits = spark.createDataFrame(
        [(1, 1, "b", [(1, "a"), (2, "b")]), (1, 2, "a", [(3, "c")]), (1, 3, "d", None)],
        "query_id BIGINT, position INT, chunk_text STRING, context_chunks ARRAY<STRUCT<chunk_id: BIGINT, chunk_text: STRING>>",
    )
    assert rows(hybrid.unique_texts(hits), "text_no", "text") == [(1, "b"), (2, "a"), (3, "c"), (4, "d")]


def test_unique_texts_are_hashed_not_sorted(spark):
    """Before, every copy of a text was sorted in each task; the order is that of pairs `(position, place)`, nulls first."""
    rng = random.Random(2)
    places = [None, -(2**31), -5, -1, 0, 1, 7, 2**31 - 1]
    given = [
        (q, p, rng.choice(["a", "b", "", None, "c"]), [(i, rng.choice("abcdefgh")) for i in range(rng.randrange(4))])
        for q in range(30) for p in rng.sample(places, 5)
    ]
    kind = "query_id BIGINT, position INT, chunk_text STRING, context_chunks ARRAY<STRUCT<chunk_id: BIGINT, chunk_text: STRING>>"
    found = hybrid.unique_texts(spark.createDataFrame(given, kind))
    want = []
    for q in range(30):
        hits = sorted((g for g in given if g[0] == q), key=lambda g: (g[1] is not None, g[1] or 0))
        texts = dict.fromkeys(t for _, _, own, near in hits for t in [own, *(c for _, c in near)] if t)
        want += [(q, t, n) for n, t in enumerate(texts, 1)]
    assert rows(found, "query_id", "text", "text_no") == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_flat_search_legacy_takes_the_worst(spark):
    v = spark.createDataFrame([(i, [float(i)], "s") for i in range(1, 6)], "vec_id BIGINT, embedding ARRAY<FLOAT>, section STRING")
    q = spark.createDataFrame([(1, [0.0], ["s"])], "query_id BIGINT, embedding ARRAY<FLOAT>, sections ARRAY<STRING>")
    assert [g[2] for g in table(knn.knn_by_section(q, v, 3))] == [1, 2, 3]
    assert [g[2] for g in table(knn.knn_by_section(q, v, 3, legacy_order=True))] == [3, 2, 1]


@pytest.mark.parametrize("kind", ["section", "cell", "code"])
def test_stored_index_is_pruned(spark, vectors, queries, tmp_path, kind):
    """Only the asked parts of an index stored by its key are read, with the same hits."""
    few = queries.where("query_id < 3").cache()
    if kind == "section":
        keyed, find = vectors, lambda index: knn.knn_by_section(few, index)
    elif kind == "cell":
        centres = ann.ivf_train(vectors, 8)
        keyed, find = ann.ivf_assign(vectors, centres), lambda index: ann.ivf_search(few, index, centres, nprobe=1)
    else:
        keyed, find = ann.lsh_codes(vectors, 64, 6), lambda index: ann.lsh_search(few, index, 64, bits=6)
    index.save(keyed, str(tmp_path), kind, "vec_id")
    stored, _ = index.load(spark, str(tmp_path))
    hits = find(stored)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert any(kind in f for f in filters), plan
    assert rows(hits) == rows(find(keyed)) != []


def test_more_keys_than_are_pushed(spark, vectors, queries, monkeypatch):
    want = rows(knn.knn_by_section(queries, vectors))
    monkeypatch.setattr(session, "PUSHED_KEYS", 1)
    assert rows(knn.knn_by_section(queries, vectors)) == want


def test_stored_lexical_index(spark, tiny, tmp_path):
    queries, chunks = tiny
    lexical.save_index(chunks, str(tmp_path))
    terms, stats = lexical.load_index(spark, str(tmp_path))
    assert rows(lexical.bm25(queries, chunks, stats=stats, terms=terms)) == rows(lexical.bm25(queries, chunks)) != []


def test_small_side_is_bounded_in_bytes(spark):
    wide = spark.range(10).selectExpr("id", "repeat('x', 1000) AS text")
    assert "broadcast" in session.small_side(wide)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in session.small_side(wide, limit_bytes=5000)._jdf.queryExecution().logical().toString().lower()


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_search_of_a_large_block_needs_small_tables_only(metric):
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(12_000, 16)), 1)  # with ties
    queries, ids = knn._Queries(np.arange(1500), vectors[:1500], None), np.arange(12_000)[::-1].copy()
    best = knn._Best(1500, 7)
    tracemalloc.start()
    knn._search_block(best, queries, ids, vectors, None, metric)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    for row in range(0, 1500, 300):
        q = vectors[row]
        d = -(vectors @ q) if metric == "cosine" else ((vectors - q) ** 2).sum(1)
        first = np.lexsort((ids, np.round(d, 6)))[:7]
        assert best.ids[row].tolist() == ids[first].tolist()


def test_grid_finds_all_over_many_partitions(spark, vectors, queries, monkeypatch):
    monkeypatch.setattr(knn, "GRID_QUERIES", 60)
    monkeypatch.setattr(knn, "GRID_VECTORS", 50)
    conf = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        some = queries.where("query_id < 150")
        assert [g[:3] for g in table(knn.knn(some, vectors, 5, broadcast_bytes=0))] == brute(vectors, some, 5, False)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
