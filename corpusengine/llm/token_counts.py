"""Token counts of a word BPE tokenizer by a finite-state automaton and a memo of pre-tokens.

The tokenizer file is compiled into one deterministic automaton, which reads character
classes and marks where its pre-tokens begin.  The number of tokens that the merges leave of a
pre-token comes from a memo, filled by the merge loop when a pre-token is first met; no
transition carries a count.

Texts of a batch form one stream cut into equal chunks.  All chunks are run side by side from every
state, which gives each chunk's state map; a parallel prefix scan composes the maps, so
each chunk's true first state is known, and one text of any length is work for all chunks.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusengine.llm.common import col, text_of

LIMIT = 2048
#: Characters of a stream: texts are joined up to it, longer ones run by themselves.
STREAM = 4_000_000
CHUNK = 1_000
#: The second transducer starts anew beyond so many transitions; longer pre-tokens get none.
TRANSITIONS, LONGEST = 400_000, 64

# Character classes, and states named after what was read last.
SPACE, OTHER, NUMBER, QUOTE, LETTER, SHORT, RV, LL, E = range(9)
START, LETTERS, OTHERS, QUOTED, QUOTED_RV, QUOTED_L = range(6)
#: Marks of a transition: a pre-token begins at this character, or began at the one before.
HERE, BEFORE = 1, 2
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """`(next state, marks)` by state and class of the transducer for `PATTERN`."""
    after, marks = np.zeros((6, 9), np.uint8), np.zeros((6, 9), np.uint8)
    letters = (LETTER, SHORT, RV, LL, E)
    for state in range(6):
        after[state, SPACE] = START
        after[state, NUMBER], marks[state, NUMBER] = START, HERE
        after[state, OTHER], marks[state, OTHER] = OTHERS, HERE
        after[state, QUOTE], marks[state, QUOTE] = QUOTED, HERE
        for c in letters:
            after[state, c], marks[state, c] = LETTERS, HERE
    for c in letters:
        marks[LETTERS, c] = 0
    for state in (OTHERS, QUOTED):
        for c in (OTHER, QUOTE):
            after[state, c], marks[state, c] = OTHERS, 0
    # A quote that begins a pre-token takes these letters with it ...
    after[QUOTED, SHORT], marks[QUOTED, SHORT] = START, 0
    after[QUOTED, RV], marks[QUOTED, RV] = QUOTED_RV, 0
    after[QUOTED, LL], marks[QUOTED, LL] = QUOTED_L, 0
    # ... where a second one must follow; else the first began a pre-token of letters.
    for state, needed in ((QUOTED_RV, E), (QUOTED_L, LL)):
        marks[state] |= BEFORE
        for c in letters:
            marks[state, c] = BEFORE
        after[state, needed], marks[state, needed] = START, 0
    return after, marks


class Transducer:
    """Token counts of texts; `source` is the tokenizer file's content."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        spec = json.loads(source)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        if split["pattern"]["Regex"] != PATTERN or model["end_of_word_suffix"] != "</w>" or model["dropout"]:
            raise ValueError("not a word BPE tokenizer of the known form")
        self.tokenizer = Tokenizer.from_str(source)
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.symbols = self._byte_symbols(model["vocab"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special)))
        self.after, self.marks = transitions()
        self.classes = np.full(0x110000, 255, np.uint8)  # filled in as characters appear
        self.counts: dict[str, int] = {}

    def _byte_symbols(self, vocab: dict[str, int]) -> list[str]:
        """The byte alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        if any(s not in vocab or s + "</w>" not in vocab for s in table.values()):
            raise ValueError("the vocabulary lacks a byte")
        return [table[b] for b in range(256)]

    # --- the first transducer ---

    def _classify(self, codes: np.ndarray) -> np.ndarray:
        """Classes of code points; the tokenizer's own pre-tokenizer tells those of new ones."""
        found = self.classes[codes]
        if (found == 255).any():
            for code in np.unique(codes[found == 255]):
                self.classes[code] = self._class(chr(code))
            found = self.classes[codes]
        return found

    def _class(self, c: str) -> int:
        for kind, members in ((QUOTE, "'"), (SHORT, "stmd"), (RV, "rv"), (LL, "l"), (E, "e")):
            if c in members:
                return kind
        if not 0xD800 <= ord(c) < 0xE000:
            spans = [s for _, s in self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{c}!")]
            if spans[0] == (0, 2):
                return LETTER
            if len(spans) == 3:
                return NUMBER
            if spans[-1][0] == 2:
                return SPACE
        return OTHER

    def first_states(self, columns: np.ndarray) -> np.ndarray:
        """The state in which each chunk begins; `columns` has a chunk in each column."""
        length, chunks = columns.shape
        states = np.repeat(np.arange(6, dtype=np.uint8)[:, None], chunks, axis=1)
        for row in columns:
            states = self.after[states, row[None, :]]
        step = 1
        while step < chunks:  # maps[i] becomes the map of chunks 0..i
            before = states[:, :-step]
            states = np.concatenate([states[:, :step], states[before, np.arange(step, chunks)[None, :]]], axis=1)
            step *= 2
        return np.concatenate([[START], states[START, :-1]]).astype(np.uint8)

    def starts(self, classes: np.ndarray) -> np.ndarray:
        """Whether a pre-token begins at each character; the last character is white space."""
        chunks = max(1, -(-len(classes) // CHUNK))
        length = -(-len(classes) // chunks)
        columns = np.full(chunks * length, SPACE, np.uint8)
        columns[: len(classes)] = classes
        columns = np.ascontiguousarray(columns.reshape(chunks, length).T)
        states, marks = self.first_states(columns), np.empty_like(columns)
        for i, row in enumerate(columns):
            marks[i] = self.marks[states, row]
            states = self.after[states, row]
        flat = marks.T.ravel()[: len(classes)]
        begins = (flat & HERE) > 0
        begins[:-1] |= (flat[1:] & BEFORE) > 0
        return begins

    # --- the second transducer ---

    def tokens(self, word: str) -> int:
        """Tokens that the merges leave of a pre-token: the pair of least rank first, the leftmost of equals."""
        parts = [self.symbols[b] for b in word.encode("utf-8", "replace")]
        parts[-1] += "</w>"
        if len(parts) == 1:
            return 1
        ranks = self.ranks
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap = [(ranks[p], i, *p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
        heapq.heapify(heap)
        count = len(parts)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            right[i] = k = right[j]
            count -= 1
            if k < len(parts):
                left[k] = i
                if (pair := (parts[i], parts[k])) in ranks:
                    heapq.heappush(heap, (ranks[pair], i, *pair))
            h = left[i]
            if h >= 0 and (pair := (parts[h], parts[i])) in ranks:
                heapq.heappush(heap, (ranks[pair], h, *pair))
        return count

    def _count(self, word: str) -> int:
        if (n := self.counts.get(word)) is None:
            n = self.tokens(word)
            if len(word) <= LONGEST:
                if len(self.counts) >= TRANSITIONS:
                    self.counts.clear()
                self.counts[word] = n
        return n

    # --- texts ---

    def _normal(self, text: str) -> str:
        """The normalised text; below U+0100 normal forms are the characters themselves."""
        if text.isascii():
            return text.lower()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.tokenizer.normalizer.normalize_str(text)
        return text.lower()

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, strings of special tokens being one each."""
        totals = np.zeros(len(texts), np.int64)
        parts: list[str] = []
        first = size = 0
        for i, text in enumerate(texts):
            if "<|" in text:
                text, totals[i] = self.special.subn("\n", text)
            parts.append(self._normal(text))
            size += len(parts[-1])
            if size >= STREAM or i + 1 == len(texts):
                totals[first : i + 1] += self._stream(parts)
                parts, first, size = [], i + 1, 0
        return totals

    def _stream(self, parts: list[str]) -> np.ndarray:
        stream = "\n".join(parts) + "\n"
        classes = self._classify(np.frombuffer(stream.encode("utf-32-le", "surrogatepass"), np.uint32))
        begins = self.starts(classes)
        borders = np.flatnonzero(begins | (classes == SPACE))
        at = np.flatnonzero(begins[borders])
        froms, tos = borders[at], borders[at + 1]
        known = self.counts.get
        words = [stream[a:b] for a, b in zip(froms.tolist(), tos.tolist(), strict=True)]
        counts = np.fromiter((known(w) or self._count(w) for w in words), np.int64, len(words))
        ends = np.cumsum([len(p) + 1 for p in parts])
        upto = np.concatenate([[0], np.cumsum(counts)])
        return np.diff(upto[np.concatenate([[0], np.searchsorted(froms, ends)])])


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """`doc_id`, `n_bytes`, `n_tokens` and whether those are over `limit`, of every row.

    Counts are those of the library for the tokenizer file at `path`, without added begin
    and end.  A null text counts as empty.  Rows are independent, whatever else they hold; one
    pass without a shuffle.
    """
    source = docs.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = Transducer(source.value)
        for batch in batches:
            rows = batch.num_rows
            step = 500
            for i in range(0, rows, step):
                part = batch.slice(i, step)
                raw = part.column("text").to_pylist()
                n = transducer.count([t.decode("utf-8", "replace") for t in raw])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), pa.array(n), pa.array(n > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.select(col("doc_id"), text_of(text).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
