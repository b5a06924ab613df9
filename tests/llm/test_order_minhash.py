import random
from collections import Counter

import numpy as np
import pytest

from corpusengine.llm import components as C, order_minhash as O
from tests.llm.conftest import ODD_TEXTS


def labelled(text):
    w = (text or "").lower().encode().split()
    grams = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    seen, out = Counter(), []
    for g in grams:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def brute_similarity(a, b):
    """By the quadratic table of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            row[j + 1], before = (before + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1] / (len(a) + len(b) - row[-1]) if a and b else 0.0


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        i = rng.randrange(len(w))
        kind = rng.randrange(3)
        w[i : i + (kind != 1)] = [] if kind == 2 else [f"new{rng.randrange(999)}"]
    return w


def corpus(seed=1):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(60, 200))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(0, 9)):
            texts.append(" ".join(edited(rng, words, rng.randrange(0, 7))))
    words = [f"h{rng.randrange(500)}" for _ in range(150)]
    texts += [" ".join(edited(rng, words, rng.choice([2, 2, 5, 6]))) for _ in range(60)]
    rng.shuffle(texts)
    return texts


def test_similarity_against_table():
    texts = corpus()[:40]
    for a in texts:
        for b in texts[:20]:
            want = brute_similarity(labelled(a), labelled(b))
            got = O.similarity(*(O.labelled_shingles(O.normal_words(t.encode())) for t in (a, b)))
            assert (got >= 0.8) == (want >= 0.8)
            if want >= 0.8:
                assert abs(got - want) < 1e-12


def brute_classes(rows):
    grams = [labelled(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(grams):
        for j in range(i):
            if a and (a == grams[j] or (set(a) & set(grams[j]) and brute_similarity(a, grams[j]) >= 0.8)):
                up[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("small, block", [(16, 256), (2, 7)])
def test_classes_against_brute_force(make_docs, tmp_path, monkeypatch, small, block):
    monkeypatch.setattr(O, "SMALL_BUCKET", small)
    monkeypatch.setattr(O, "BLOCK", block)
    monkeypatch.setattr(O, "COLUMNS", 500)
    texts = corpus()[:110] + ["one two", "One  two", "one two three", None, "", *["same words here again and again"] * 4]
    ids = [5_000 - i for i in range(len(texts))]
    ids[-1], ids[-2] = None, ids[-3]
    docs = make_docs(texts, tmp_path, ids)
    order = {r[O.ROW]: i for i, r in enumerate(O.numbered(docs).collect())}
    stored = [(r.doc_id, r.text) for r in docs.collect()]
    got = O.classes(docs).collect()
    assert len(got) == len(texts)
    groups = {}
    for r in got:
        groups.setdefault(r.class_id if r.class_id is not None else ("row", r[O.ROW]), []).append(order[r[O.ROW]])
    assert {frozenset(g) for g in groups.values()} == brute_classes(stored)
    for r in got:
        assert not r.first or r.class_id == r.doc_id
    firsts = [r for r in got if r.first]
    assert len(firsts) == len(groups) and O.deduplicated(docs).count() == len(firsts)


def test_odd_texts_and_no_rows(make_docs, tmp_path):
    got = {r.doc_id: r.class_id for r in O.classes(make_docs(ODD_TEXTS, tmp_path)).collect()}
    assert {i for i, c in got.items() if i != c} == {5}
    empty = make_docs([], tmp_path)
    assert O.classes(empty).count() == 0 and O.deduplicated(empty).columns == empty.columns


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98)]
    got = dict(C.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {98: 98, 99: 98, 100: 98}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_candidates_meet_at_the_threshold():
    """Pairs just over the threshold share a band, but for odds of 2e-4."""
    rng, missed = random.Random(4), 0
    for _ in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(180)]
        a, b = (O.labelled_shingles([x.encode() for x in w]) for w in (words, edited(rng, words, 3)))
        if O.similarity(a, b) >= 0.8:
            missed += not (np.array(O.sketch(a)[0]) == np.array(O.sketch(b)[0])).any()
    assert missed <= 1
