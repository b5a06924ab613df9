"""SentencePiece ids and back through a table of distinct marked words.

No piece of the vocabulary holds a white-space marker after another character, so a text
divides before every marker that follows one: no piece crosses these places, and each
marked word has the same pieces wherever it stands.  Its ids are found once and joined to
its places.

The words that make up most of the corpus are found by a count over it, are at most
`1 / SHARE` many, and reach all tasks as one table.  The others go into a table of the task
that meets them: sending each occurrence of them through a shuffle and the ids back
would move more than the corpus itself.

Tables hold a word without its first marker and with spaces for the others.  Most words decode to themselves;
the text of the others is in a table of its own, so that a text without them is its own decoded text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusengine.llm.common import col, text_of
from corpusengine.llm.frequent import counted, frequent
from corpusengine.session import materialize

MARK = "▁"
#: A task's own table is emptied beyond so many words; longer words do not enter it.
TABLE_WORDS, WORD_CHARS = 300_000, 200
#: Characters whose words are looked up at a time, unless one text is longer.
PART_CHARS = 1 << 18
_SPACED = re.compile("(?:^| )( *[^ ]*)")


def spaced_words(text: str) -> list[str]:
    """The text divided at the first space of each run, which is dropped; markers count as spaces."""
    text = text.replace(MARK, " ")
    if "  " in text or text[:1] == " ":
        return _SPACED.findall(text)
    return text.split(" ") if text else []


def marked_words(text: str) -> list[str]:
    """The text with its leading and other spaces as markers, divided before each run of them."""
    return [MARK + w.replace(" ", MARK) for w in spaced_words(text)]


def _split(raw: bytes) -> Iterable[str]:
    words = spaced_words(raw.decode("utf-8", "replace"))
    return words if max(map(len, words), default=0) < WORD_CHARS else [w for w in words if len(w) < WORD_CHARS]


class Codec:
    """Encodes marked words and turns ids into text; `model` is the content of the model file."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        size = range(self.model.get_piece_size())
        self.pieces = [self.model.id_to_piece(i) for i in size]
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece crosses a white-space marker")
        self.control = {i for i in size if self.model.is_control(i)}
        self.bytes = {i: int(self.pieces[i][3:-1], 16) for i in size if self.model.is_byte(i)}
        self.texts = [None if i in self.bytes else "" if i in self.control else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.lone = [self.model.piece_to_id(MARK)]
        self.bos, self.eos = self.model.bos_id(), self.model.eos_id()

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of marked words."""
        return self.encode_spaced([w[1:].replace(MARK, " ") for w in words])

    def encode_spaced(self, words: list[str]) -> list[list[int]]:
        """Ids of words as the tables hold them; the library puts the first marker itself, but not before nothing."""
        found = self.model.encode(words, num_threads=1)
        return [x if w else self.lone for w, x in zip(words, found, strict=True)]

    def decode(self, ids: Iterable[int]) -> str:
        """The pieces' text with markers as spaces; runs of byte pieces are read as UTF-8."""
        found = [self.texts[i] for i in ids]
        if None not in found:
            return "".join(found)
        out, run = [], bytearray()
        for i, text in zip(ids, found, strict=True):
            if text is None:
                run.append(self.bytes[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(text)
        return "".join(out) + run.decode("utf-8", "replace")

    def segmented(self, words: list[str]) -> tuple[list[bytes], dict[str, str]]:
        """Ids of words as the tables hold them, and the text of those that do not decode to themselves."""
        found = self.encode_spaced(words)
        flat = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        ends = [0, *(4 * np.cumsum([len(x) for x in found])).tolist()]
        texts = ((w, self.decode(x)) for w, x in zip(words, found, strict=True))
        return [flat[a:b] for a, b in zip(ends, ends[1:])], {w: d for w, d in texts if d != " " + w}


def encoded(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, `ids` and `decoded` of every row.

    `ids` (array of int) are those of the library with begin and end ids, `decoded` is their text.
    A null text counts as empty.  Rows are independent, whatever else they hold.
    """
    return _mapped(docs, model_path, text, keep, "ids array<int>, decoded string", _whole)


def report(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """`doc_id`, the number of ids and SHA-256 digests of the ids and of the decoded text."""
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _mapped(docs, model_path, text, ("doc_id",), kinds, _digests)


def _whole(ids: list[bytes], decoded: list[str]) -> list[pa.Array]:
    return [
        pa.array([np.frombuffer(x, np.uint32).astype(np.int32) for x in ids], pa.list_(pa.int32())),
        pa.array(decoded, pa.string()),
    ]


def _digests(ids: list[bytes], decoded: list[str]) -> list[pa.Array]:
    return [
        pa.array([len(x) // 4 for x in ids], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
    ]


def distinct_words(docs: DataFrame, model_path: str, text: str = "text") -> tuple[dict[str, bytes], dict[str, str]]:
    """Ids of each frequent word, segmented once, and the texts of those that differ; at most `1 / SHARE` entries."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(open(model_path, "rb").read())

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value)
        for batch in batches:
            words = [w.decode() for w in batch.column("unit").to_pylist()]
            ids, texts = codec.segmented(words)
            columns = [pa.array(words), pa.array(ids, pa.binary()), pa.array([texts.get(w) for w in words], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["word", "ids", "decoded"])

    source = docs.select(text_of(text).cast("binary").alias("text"), F.lit(False).alias("flag"))
    counts = materialize(counted(source, _split).select("unit", "n"), "marked-words")
    table = frequent(counts).select("unit").mapInArrow(segment, "word string, ids binary, decoded string").toArrow()
    words, ids, texts = (table.column(c).to_pylist() for c in ("word", "ids", "decoded"))
    return dict(zip(words, ids, strict=True)), {w: d for w, d in zip(words, texts, strict=True) if d is not None}


def _parts(texts: pa.Array) -> Iterator[list[str]]:
    part, chars = [], 0
    for value in texts:
        part.append(value.as_py().decode("utf-8", "replace"))
        chars += len(part[-1])
        if chars >= PART_CHARS:
            yield part
            part, chars = [], 0
    yield part


def _mapped(docs, model_path, text, keep, kinds, results) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(distinct_words(docs, model_path, text))
    model = spark.sparkContext.broadcast(open(model_path, "rb").read())

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, (common, unlike) = Codec(model.value), shared.value
        table, odd = dict(common), dict(unlike)
        ends = [np.array([x], "<u4").tobytes() for x in (codec.bos, codec.eos)]
        for batch in batches:
            ids, decoded = [], []
            for texts in _parts(batch.column("__llm_text")):
                if len(table) > len(common) + TABLE_WORDS:
                    table, odd = dict(common), dict(unlike)
                words = [spaced_words(t) for t in texts]
                fresh = list(set().union(*words).difference(table))
                found, texts_of = codec.segmented(fresh)
                table.update(zip(fresh, found, strict=True))
                odd.update(texts_of)
                for t, ws in zip(texts, words, strict=True):
                    ids.append(ends[0] + b"".join(map(table.__getitem__, ws)) + ends[1])
                    alike = odd.keys().isdisjoint(ws) if odd else True
                    decoded.append(t.replace(MARK, " ") if alike else "".join([odd[w] if w in odd else " " + w for w in ws])[1:])
                for w in [w for w in fresh if len(w) >= WORD_CHARS]:
                    del table[w]
                    odd.pop(w, None)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, *results(ids, decoded)], names)

    kept_columns = docs.select(*[col(c) for c in keep])
    schema = T.StructType(kept_columns.schema.fields + T.StructType.fromDDL(kinds).fields)
    rows = docs.select(
        *[col(c).alias(f"kept{i}") for i, c in enumerate(keep)], text_of(text).cast("binary").alias("__llm_text")
    )
    names = schema.names
    return rows.mapInArrow(convert, schema)
