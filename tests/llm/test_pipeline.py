from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline
from corpusengine.llm import line_dedup, line_quality, mixing, order_minhash
from tests.conftest import SF
from tests.llm.conftest import ODD_TEXTS


def test_stages_take_effect(spark, tmp_path):
    """Each stage's rows follow from its own input and its operator's report."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, sizes = docs, [*sizes, docs.count()]
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            assert ids == sorted(r.doc_id for r in line_quality.report(before).where("kept").collect())
        if k == 1:
            assert len(ids) == sizes[-1]
            assert line_dedup.report(before).where("n_dropped > 0").count() == before.join(docs.withColumnRenamed("text", "t"), "doc_id").where("text <> t").count()
        if k == 2:
            assert ids == sorted(r.doc_id for r in order_minhash.classes(before).where("first").collect())
        if k == 3:
            assert ids == sorted(r.doc_id for r in mixing.drawn(before).collect() for _ in range(r.copies))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
    for r in docs.collect():
        assert list(r.ids) == library.encode(texts[r.doc_id], add_bos=True, add_eos=True)


def test_odd_rows_and_no_rows(spark, make_docs, tmp_path):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for texts in (ODD_TEXTS, []):
        docs = make_docs(texts, tmp_path, [None] * len(texts))
        quality, lines, near, mix, encode = (stage(spark, docs, "") for _, stage in corpus_pipeline.STAGES)
        for stage in (quality, lines, near, mix):
            assert stage.columns == docs.columns
        # Nothing here has the 50 words of a document but the long text, which is one word over and over.
        assert quality.count() == line_quality.report(docs).where("kept").count() == 0
        # No line is in ten documents.
        assert sorted(r.text for r in lines.collect()) == sorted(t or "" for t in texts)
        # Only the repeated text is a copy.
        assert near.count() == order_minhash.classes(docs).where("first").count()
        assert len({r.text for r in near.collect()} - {None, ""}) == len({t for t in texts} - {None, ""})
        # One source: every row once, at most twice.
        drawn = Counter(r.text for r in mix.collect())
        assert all(n <= drawn[t] <= 2 * n for t, n in Counter(texts).items())
        assert sorted(list(r.ids) for r in encode.collect()) == sorted(library.encode(t or "", add_bos=True, add_eos=True) for t in texts)
