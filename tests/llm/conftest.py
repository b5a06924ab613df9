import pytest

LONG = "word " * 30_000


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of given texts; `doc_id` counts from 0 unless given, further columns clash."""

    def make(texts, tmp, ids=None, **extra):
        ids = list(range(len(texts))) if ids is None else ids
        kinds = "doc_id long, text string, lang string, source string, n_chars long, t string, at int, key string, `a.b` string"
        rows = [(i, t, None, "s", None, "x", 1, None, "y") for i, t in zip(ids, texts, strict=True)]
        spark.createDataFrame(rows, kinds).write.parquet(str(tmp / "documents.parquet"), mode="overwrite")
        return spark.read.parquet(str(tmp / "documents.parquet"))

    return make


#: Nulls, empties, white space, repeats, very long texts, odd characters.
ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "a", "  two  spaces ", "▁x▁ y ", "tab\tand\x0bmore\x00z", "é é ﬁ ΑΣ İ",
    "<|endoftext|> <s> </s> <unk>", "'s ' 'r 're ''s don't we'll x'rx !'s", "x" * 5_000, LONG, "　  ", "😀 각 ㅎ",
    "line one\nline one\n LINE ONE \nend",
]
