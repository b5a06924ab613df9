import glob
import os
import random

import pytest

from corpusengine.operators import lexical, postings
from corpusengine.plans.catalog import QUERIES
from tests.conftest import SF, rows


def corpus(n=400, seed=1):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"w{min(int(draw.expovariate(0.05)), 200)}" for _ in range(draw.choice([0, 3, 20, 80]))]
        # A few chunks are far better than all others, so most blocks cannot reach the k-th score.
        out.append((i, f"s{i % 3}", " ".join(words + ["rare"] * (6 if i % 90 == 0 else 0))))
    return out + [(n, "s0", None), (n + 1, None, "w1 rare"), (n + 2, "s1", "w1 w1")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(corpus(), "chunk_id long, section string, text string").where("text IS NOT NULL")


def queries(spark):
    asked = [(1, "rare w3", ["s0", "s1"]), (2, "W1 w1 w2 w9 nothing", ["s2"]), (3, "w0 w1", ["s0", "s1", "s2"]), (4, "", ["s0"]), (5, "w5", ["none"]), (6, "rare", ["s0"])]
    return spark.createDataFrame(asked, "query_id long, query string, sections array<string>")


def newest(spark, label):
    found = glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/corpusengine/{label}-*")
    return spark.read.parquet(max(found, key=os.path.getmtime))


@pytest.mark.parametrize(("k", "block", "first"), [(3, 10, 5), (1000, 2048, 2)])
def test_equal_to_the_scores_of_all_pairs(spark, chunks, tmp_path, k, block, first):
    postings.save(chunks, str(tmp_path), block)
    lists, stats = postings.load(spark, str(tmp_path))
    got = postings.bm25(queries(spark), lists, stats, k, first=first)
    want = rows(lexical.bm25(queries(spark), chunks, k))
    assert rows(got) == want and len({r[0] for r in want}) >= 4
    if k == 3:
        # The second round leaves out blocks whose bound does not reach the k-th score.
        later = newest(spark, "block-bounds").where(f"query_id = 1 AND turn > {first}").count()
        assert newest(spark, "blocks-in-reach").where("query_id = 1").count() < 0.5 * later


def test_only_the_asked_lists_are_read(spark, chunks, tmp_path):
    postings.save(chunks, str(tmp_path), 10)
    lists, stats = postings.load(spark, str(tmp_path))
    postings.bm25(queries(spark).where("query_id = 6"), lists, stats).collect()
    held = newest(spark, "asked-lists")
    assert {(r.section, r.term) for r in held.select("section", "term").collect()} == {("s0", "rare")}
    assert max(len(r.ids) for r in lists.select("ids").collect()) <= 30
    assert postings.load(spark, str(tmp_path / "nothing")) is None


def test_no_queries_and_no_chunks(spark, chunks, tmp_path):
    postings.save(chunks.limit(0), str(tmp_path))
    lists, stats = postings.load(spark, str(tmp_path))
    assert postings.bm25(queries(spark), lists, stats).count() == 0


def test_terms_meet_the_pools_by_profile(spark, tmp_path):
    """Rare terms that are alike are one row before they are multiplied by the pools, and statistics come from the lists."""
    held = [(i, f"s{i % 4}", f"common common own{i} other{i}") for i in range(200)]
    chunks = spark.createDataFrame(held, "chunk_id long, section string, text string")
    asked = [(i, f"common own{i}", [f"s{i % 4}", f"s{(i + j) % 4}"]) for j in (1, 2) for i in range(4 * j - 4, 4 * j)]
    asked = spark.createDataFrame(asked, "query_id long, query string, sections array<string>")
    postings.save(chunks, str(tmp_path))
    stored = postings.load(spark, str(tmp_path))
    whole = sorted((r.section, r.term or "", r.df, r.len or 0) for r in lexical._counts(lexical._terms(chunks)).collect())
    assert sorted((r.section, r.term or "", r.df, r.len or 0) for r in stored[1].collect()) == whole
    assert rows(postings.bm25(asked, *stored)) == rows(lexical.bm25(asked, chunks))
    # 401 terms, of which `common` has one profile and those of a single chunk one for each section.
    assert sorted(r.n_terms for r in newest(spark, "term-profiles").collect()) == [1, 100, 100, 100, 100]


def folders(spark, label):
    return len(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/corpusengine/{label}-*"))


def test_lists_are_made_where_a_block_is(spark, chunks, tmp_path, monkeypatch):
    """Texts move once to slices of their section; neither term frequencies nor postings are written or moved for the lists."""
    monkeypatch.setattr(postings, "BLOCK_TOKENS", 4)
    monkeypatch.setattr(postings, "SLICE_TOKENS", 500)
    monkeypatch.setattr(postings, "HELD_TOKENS", 50)
    monkeypatch.setattr(postings, "BATCH_LISTS", 7)
    odd = [(7001, "s1", "\x1cÀB àb  \tx\x85İ 日本 x"), (7002, "s2", " \n "), (7003, "s2", None), (7004, None, "w1"), (7001, "s1", "x y")]
    chunks = chunks.unionByName(spark.createDataFrame(odd, "chunk_id long, section string, text string"))
    before = folders(spark, "chunk-terms")
    postings.save(chunks, str(tmp_path), 10)
    assert folders(spark, "chunk-terms") == before
    lists, stats = postings.load(spark, str(tmp_path))
    held = lists.collect()
    got = sorted((r.section, r.term, *x) for r in held for x in zip(r.ids, r.tfs, r.lens, strict=True))
    terms = lexical._terms(chunks).where("section IS NOT NULL").collect()
    assert got == sorted((r.section, x.term, r.chunk_id, x.tf, r.len) for r in terms for x in r.terms)
    assert all((r.max_tf, r.min_len) == (max(r.tfs), min(r.lens)) for r in held)
    assert len({(r.section, r.term, r.block) for r in held}) == len(held)
    found = sorted((r.section or "", r.term or "", r.df, r.len or 0) for r in stats.collect())
    whole = lexical._counts(lexical._terms(chunks)).where("section IS NOT NULL OR term IS NULL").collect()
    assert found == sorted((r.section or "", r.term or "", r.df, r.len or 0) for r in whole)


def test_the_query_writes_no_texts(spark):
    before = folders(spark, "embedded-chunks")
    assert QUERIES["bm25_postings"](spark, SF).count() > 0
    assert folders(spark, "embedded-chunks") == before
