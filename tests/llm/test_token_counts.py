import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusengine.llm import token_counts
from tests.llm.conftest import ODD_TEXTS

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def transducer():
    return token_counts.Transducer(open(PATH, encoding="utf-8").read())


def random_texts(n):
    rng = random.Random(3)
    letters = list("abrvelstmd'''  !.1²½ é́İΣςK  \u0085ﬁ각中😀<|>") + ["<|endoftext|>", "'re", "'ll", "<|STARTOFTEXT|>", "가", "the", "ing"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_counts_equal_the_library_s(transducer, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", 7)
    monkeypatch.setattr(token_counts, "STREAM", 1_000)
    texts = random_texts(6_000) + [t or "" for t in ODD_TEXTS]
    assert transducer.count(texts).tolist() == library(texts)


def test_every_character(transducer):
    texts = [f"a{chr(c)}1{chr(c)}'{chr(c)} {chr(c)}!" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    bad = [t for t, a, b in zip(texts, transducer.count(texts), library(texts), strict=True) if a != b]
    assert not bad


def test_prefix_scan_equals_one_run(transducer):
    rng = np.random.default_rng(1)
    columns = rng.integers(0, 9, (13, 29)).astype(np.uint8)
    state, want = token_counts.START, []
    for column in columns.T:
        want.append(state)
        for c in column:
            state = transducer.after[state, c]
    assert transducer.first_states(columns).tolist() == want


def test_operator(make_docs, tmp_path):
    docs = make_docs(ODD_TEXTS, tmp_path)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, PATH).collect()}
    n = library([t or "" for t in ODD_TEXTS])
    assert got == {i: (len((t or "").encode()), n[i], n[i] > 2048) for i, t in enumerate(ODD_TEXTS)}
    assert token_counts.token_counts(make_docs([], tmp_path), PATH).count() == 0
