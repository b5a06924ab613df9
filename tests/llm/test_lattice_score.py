import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest

from corpusengine.llm import frequent, lattice_score as S
from tests.llm.conftest import ODD_TEXTS

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def brute_marginal(symbols, weights):
    total = 0.0
    for k in range(len(symbols)):
        for cuts in combinations(range(1, len(symbols)), k):
            p = 1.0
            for a, b in zip((0, *cuts), (*cuts, len(symbols)), strict=True):
                p *= weights.get(tuple(symbols[a:b]), 0.0)
            total += p
    return total


@pytest.fixture
def small():
    pieces = [(S.MARK,), (S.MARK, 97), (97,), (98,), (97, 98), (98, 97, 98), (S.MARK, 97, 98, 97)]
    logs = np.log(np.concatenate([np.linspace(1, 2, len(pieces)), np.full(256, 0.01)]) / 20)
    table = {p: math.exp(x) for p, x in zip(pieces, logs, strict=False)}
    for b in range(256):
        table[(b,)] = table.get((b,), 0) + math.exp(logs[len(pieces) + b])
    return S.Lattice(pieces, logs), table


WORDS = [b"a", b"ab", b"abab", b"bbab", b"xyz", b"ababa", b"caba", b"abaab"]


def test_marginals_against_all_segmentations(small):
    lattice, table = small
    got = lattice.log_marginals(WORDS)
    for w, x in zip(WORDS, got, strict=True):
        assert math.isclose(math.exp(x), brute_marginal([S.MARK, *w], table), rel_tol=1e-9)


def test_expected_uses_are_the_derivative(small):
    lattice, _ = small
    uses, step = lattice.expected(WORDS), 1e-6
    for k in (1, 3, 4, lattice.first_byte + 120):
        moved = S.Lattice.__new__(S.Lattice)
        moved.__dict__ = dict(lattice.__dict__, weights=lattice.weights.copy())
        moved.weights[k] += step
        slope = (moved.log_marginals(WORDS).sum() - lattice.log_marginals(WORDS).sum()) / step
        assert math.isclose(uses[k], slope, rel_tol=1e-3, abs_tol=1e-6)


@pytest.mark.parametrize("share", [2e-6, 0.02])
def test_scores(make_docs, tmp_path, monkeypatch, share):
    monkeypatch.setattr(frequent.threshold, "__defaults__", (share,))
    texts = [*ODD_TEXTS, "the cat sat", "The dog SAT down", "a cat", "a cat", "unseen zebra"] * 2
    ids = [*range(len(texts) - 2), None, 5]
    docs = make_docs(texts, tmp_path, ids)
    got = {}
    for r in S.document_scores(docs, MODEL).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(texts)
    words = [[w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + [None] for t in texts]
    out = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i in ids]
    c = Counter(w for ws, o in zip(words, out, strict=True) if not o for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws, o in zip(ids, words, out, strict=True):
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        fits = [
            r for r in got[i]
            if math.isclose(r.base_score, base, rel_tol=1e-9) and r.n_tokens == len(ws) and r.n_known == sum(c[w] > 0 for w in ws)
        ]
        assert fits and fits[0].held_out == o and fits[0].train_tokens == n
        assert math.isfinite(fits[0].score) and fits[0].score < 0 and math.isfinite(fits[0].spelled_score)


def test_no_rows_and_no_training_rows(make_docs, tmp_path):
    assert S.document_scores(make_docs([], tmp_path), MODEL).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = S.document_scores(make_docs(["some text"], tmp_path, [held]), MODEL).collect()
    assert (row.held_out, row.n_known, row.train_tokens, row.base_score) == (True, 0, 0, 0.0) and row.score < 0
