import hashlib
import random
import re

import numpy as np
import public_tokenizers
import sentencepiece

from corpusengine.llm import piece_codec
from tests.llm.conftest import ODD_TEXTS

MODEL = public_tokenizers.path("piece_bpe_32k.model")


LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def library(text):
    ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
    return ids, LIBRARY.decode(ids)


def test_words_join_to_the_library_s_ids():
    codec = piece_codec.Codec(open(MODEL, "rb").read())
    rng = random.Random(5)
    letters = list("ab  ▁\n\t\r.ée　ㅎ각😀\x00<s>0x4A>́ #")
    for _ in range(3_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        parts = codec.encode(piece_codec.marked_words(text))
        want, decoded = library(text)
        assert [1, *(i for p in parts for i in p), 2] == want
        assert "".join(map(codec.decode, parts))[1:] == decoded


def test_report_and_encoded(make_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(piece_codec, "TABLE_WORDS", 3)
    docs = make_docs(ODD_TEXTS, tmp_path)
    got = {r.doc_id: r for r in piece_codec.report(docs, MODEL).collect()}
    full = {r.doc_id: r for r in piece_codec.encoded(docs, MODEL, keep=("doc_id", "a.b")).collect()}
    assert len(got) == len(ODD_TEXTS)
    for i, text in enumerate(ODD_TEXTS):
        ids, decoded = library(text)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        assert list(full[i].ids) == ids and full[i].decoded == decoded and full[i]["a.b"] == "y"


def test_empty_table(make_docs, tmp_path):
    docs = make_docs([], tmp_path)
    assert piece_codec.report(docs, MODEL).count() == 0


def test_only_words_that_decode_otherwise_keep_their_text(make_docs, tmp_path, monkeypatch):
    """Before, each word's text was stored, found again and joined beside its ids; now a text of other words is its own."""
    letters = list("ab  ▁\n\t\r.ée　ㅎ각😀\x00<s>0x4A>́ #")
    rng = random.Random(7)
    texts = ["".join(rng.choices(letters, k=rng.randrange(30))) for _ in range(2_000)]
    marked = re.compile("▁+[^▁]*")
    for t in texts:
        want = marked.findall("▁" + t.replace(" ", "▁")) if t else []
        assert piece_codec.marked_words(t) == want == ["▁" + w.replace(" ", "▁") for w in piece_codec.spaced_words(t)]
    codec = piece_codec.Codec(open(MODEL, "rb").read())
    words = sorted({w for t in texts for w in piece_codec.spaced_words(t)})
    ids, unlike = codec.segmented(words)
    assert ids == [np.array(x, "<u4").tobytes() for x in codec.encode_spaced(words)] and codec.segmented([]) == ([], {})
    assert all(unlike.get(w, " " + w) == codec.decode(x) for w, x in zip(words, codec.encode_spaced(words), strict=True))
    known, other = piece_codec.distinct_words(make_docs(["two words two words"] * 3, tmp_path), MODEL)
    assert set(known) == {"two", "words"} and other == {}


def test_texts_of_a_model_that_changes_words(make_docs, tmp_path, monkeypatch):
    """Frequent, rare and long words with ligatures and full-width letters, which this model rewrites."""
    monkeypatch.setattr(piece_codec, "WORD_CHARS", 9)
    texts = ["ﬁne wine ﬁne", "plain wine", "Ｆull ﬁne plain", "ﬁrstﬁrstﬁrst wine", ""]
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter(["fine wine first Full plain"] * 50), model_prefix=str(tmp_path / "small"), vocab_size=290, byte_fallback=True,
        model_type="bpe", character_coverage=1.0, minloglevel=2, hard_vocab_limit=False,
    )
    path = str(tmp_path / "small.model")
    small = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in piece_codec.encoded(make_docs(texts, tmp_path), path).collect()}
    for i, text in enumerate(texts):
        ids = small.encode(text, add_bos=True, add_eos=True)
        assert list(got[i].ids) == ids and got[i].decoded == small.decode(ids) != (text if "ﬁ" in text else None)
    known, unlike = piece_codec.distinct_words(make_docs(texts, tmp_path), path)
    assert unlike == {"ﬁne": " fine"} and "wine" in known
