import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusengine.functions.arrow import cut_recursively
from corpusengine.operators import chunking
from corpusengine.plans.catalog_sql import split_recursively
from tests.conftest import rows

SEPS = ("\n\n", "\n", " ", "")


def scored(spark):
    data = [(i + 1, "A" if i < 4 else "B", f"t{i + 1}", c) for i, c in enumerate([0.9, 0.5, 0.7, 0.9, 0.5, 0.9])]
    return spark.createDataFrame(data, "id BIGINT, section_id STRING, chunk_text STRING, confidence_score DOUBLE").repartition(3)


@pytest.mark.parametrize("block", [1, 2, 4, 4096])
def test_context(spark, block):
    got = chunking.context(scored(spark), ["section_id"], block=block)
    ids = F.transform("context_chunks", lambda c: c["chunk_id"])
    assert [r[1] for r in rows(got, "id", ids)] == [[1, 2], [1, 2, 3, 4], [1, 2, 3, 4], [3, 4], [5, 6], [5, 6]]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_links(spark, block):
    got = rows(chunking.link(scored(spark), ["section_id"], block=block), "id", "prev_chunk_id", "next_chunk_id")
    assert got == [(1, None, 2), (2, 1, 3), (3, 2, 4), (4, 3, None), (5, None, 6), (6, 5, None)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n.é", max_size=300), st.integers(5, 40), st.integers(0, 5))
def test_split_invariants(text, size, overlap):
    pieces = cut_recursively(text, size, overlap, SEPS)
    assert all(0 < len(p) <= size and p == p.strip() for p in pieces)
    # each piece occurs in order, and every non-blank character is covered
    at, covered = 0, set()
    for p in pieces:
        found = text.find(p, max(at, 0))
        assert found >= 0
        covered |= set(range(found, found + len(p)))
        at = found + 1 - overlap - size
    assert sum(not c.isspace() for c in "".join(pieces)) >= sum(not c.isspace() for c in text)


def test_split_keeps_unbreakable_tokens():
    token = "x" * 150
    assert cut_recursively(f"aa {token} bb", 100, 20, chunking.TOPIC_SEPARATORS) == ["aa", " " + token, "bb"]


def test_split_overlap():
    assert cut_recursively("aaa bbb ccc ddd eee", 10, 4, SEPS) == ["aaa bbb", "bbb ccc", "ccc ddd", "ddd eee"]
    assert cut_recursively("one. two. three", 6, 0, (". ", " ")) == ["one", ". two", ".", " three"]


def test_build_chunks(spark):
    topics = spark.createDataFrame(
        [(1, 1, "S001", "alpha beta gamma. " * 20, ["alpha"]), (1, 2, "S002", "short text", ["text"]), (2, 1, "S001", " ", [])],
        "doc_id BIGINT, topic_seq BIGINT, section_id STRING, text STRING, keywords ARRAY<STRING>",
    )
    chunks = chunking.build_chunks(topics, ["doc_id", "topic_seq"], ["doc_id", "section_id"])
    got = rows(chunks, "id", "section_id", "index_in_para", "prev_chunk_id", "next_chunk_id")
    assert [g[0] for g in got] == list(range(1, len(got) + 1))
    assert got[-1][1:] == ("S002", 1, None, None)
    assert got[0][3] is None and got[-2][4] is None
    assert all(r["text"].strip() for r in chunks.select("text").collect())


def test_sql_of_the_recursive_split():
    """The SQL that stands beside `recursive_chunks` equals the function on small random texts and limits."""
    rng = random.Random(1)
    bits = ["a", "b", "é", " ", " ", "\n", "\n\n"]
    texts = ["".join(rng.choice([*bits, "x" * rng.randint(1, 9)]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    for size, overlap in ((12, 5), (7, 0), (9, 9)):
        sql = f"WITH RECURSIVE {split_recursively(size, overlap).strip()} SELECT doc_id, text FROM pieces WHERE text <> '' ORDER BY doc_id, place, no"
        got = {}
        for doc, piece in con.execute(sql).fetchall():
            got.setdefault(doc, []).append(piece)
        want = {i: cut_recursively(t, size, overlap, chunking.PLAIN_SEPARATORS) for i, t in enumerate(texts) if t.strip()}
        assert got == want
