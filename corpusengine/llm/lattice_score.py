"""Document likelihood over all segmentations of words into pieces of an existing vocabulary.

A word is the lattice of all its segmentations into pieces and single bytes.  A forward pass in
log space gives its marginal probability.  The vocabulary's scores weight the pieces; one
expectation step over the distinct training words then sharpens the weights, with the
scores as prior.  A word seen in training has one more arc, its own count, and the pieces
share the mass of the distinct words, so that frequent words need no spelling.

Every distinct word is scored once.  The frequent ones reach all tasks as a table of at most
`1 / SHARE` entries, the occurrences of the others are joined by word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusengine.llm.common import ROW, col, numbered, text_of
from corpusengine.llm.frequent import counted, threshold
from corpusengine.session import materialize

#: One in so many documents is held out.
FOLDS = 10
#: Added to each count by the base.
BASE = 0.1
#: Symbols of a word: its bytes, and first this one, which stands for the word's start.
MARK, SYMBOLS = 256, 257
#: Cells of the matrix that words of similar length share.
CELLS = 400_000
#: Constant of the rank law that turns the ranks of a merge vocabulary into weights.
RANK_SHIFT = 2.7


def pieces_of(model: bytes) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """Pieces as symbols and their natural log weights, then the 256 bytes'.

    Scores of a merge vocabulary are ranks, which weigh as `1 / (rank + RANK_SHIFT)`; bytes
    weigh as the last rank.  Pieces with a marker inside never match a word and stay out.
    """
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_proto=model)
    pieces, ranks = [], []
    for i in range(sp.get_piece_size()):
        piece, score = sp.id_to_piece(i), sp.get_score(i)
        start = piece.startswith("▁")
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) or "▁" in piece[1:]:
            continue
        # Texts are lower-cased in A-Z, so a piece with such letters never matches.
        pieces.append(((MARK,) if start else ()) + tuple((piece[1:] if start else piece).encode()))
        ranks.append(min(-score, sp.get_piece_size()))  # the lone marker's score says that no merge makes it
    weights = 1 / (np.concatenate([np.array(ranks), np.full(256, max(ranks))]) + RANK_SHIFT)
    return pieces, np.log(weights / weights.sum())


class Lattice:
    """Forward and backward passes over words; `weights` are logs of pieces, then of bytes."""

    def __init__(self, pieces: list[tuple[int, ...]], weights: np.ndarray):
        nodes: list[dict[int, int]] = [{}]
        self.piece_at = [-1]
        for p, symbols in enumerate(pieces):
            at = 0
            for s in symbols:
                at = nodes[at].setdefault(s, len(nodes))
                if at == len(nodes):
                    nodes.append({})
                    self.piece_at.append(-1)
            self.piece_at[at] = p
        self.piece_at = np.array(self.piece_at)
        self.child = np.full((len(nodes), SYMBOLS), -1, np.int32)
        for at, edges in enumerate(nodes):
            for s, to in edges.items():
                self.child[at, s] = to
        self.weights, self.first_byte = weights, len(pieces)

    def batches(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """`(places, lengths, symbols)` of words of similar length, the longest first."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):
            longest = lengths[order[at]]
            chosen = order[at : at + max(1, CELLS // longest)]
            chosen = chosen[lengths[chosen] * 2 > longest]
            symbols = np.full((len(chosen), longest), -1, np.int16)
            symbols[:, 0] = MARK
            flat = np.frombuffer(b"".join([words[i] for i in chosen]), np.uint8)
            own = np.arange(1, longest)[None, :] < lengths[chosen][:, None]
            symbols[:, 1:][own] = flat
            yield chosen, lengths[chosen], symbols
            at += len(chosen)

    def arcs(self, lengths: np.ndarray, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
        """`(words, from, to, weight index)` of all arcs, by rising `from`."""
        longest = symbols.shape[1]
        within = np.searchsorted(-lengths, -np.arange(longest), side="left")  # words longer than a position
        for i in range(longest):
            rows = np.arange(within[i])
            if i:
                yield rows, i, i + 1, self.first_byte + symbols[rows, i]
            state = np.zeros(len(rows), np.int32)
            for j in range(i, longest):
                if len(rows) and rows[-1] >= within[j]:
                    keep = rows < within[j]
                    rows, state = rows[keep], state[keep]
                state = self.child[state, symbols[rows, j]]
                on = state >= 0
                rows, state = rows[on], state[on]
                if not len(rows):
                    break
                piece = self.piece_at[state]
                if (ends := piece >= 0).any():
                    yield rows[ends], i, j + 1, piece[ends]

    def log_marginals(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the probability of each word, over all its segmentations."""
        out = np.empty(len(words))
        for places, lengths, symbols in self.batches(words):
            alpha = np.full((len(lengths), symbols.shape[1] + 1), -np.inf)
            alpha[:, 0] = 0
            for rows, i, j, w in self.arcs(lengths, symbols):
                alpha[rows, j] = np.logaddexp(alpha[rows, j], alpha[rows, i] + self.weights[w])
            out[places] = alpha[np.arange(len(lengths)), lengths]
        return out

    def expected(self, words: list[bytes]) -> np.ndarray:
        """Expected uses of every piece and byte over the segmentations of `words`."""
        total = np.zeros(len(self.weights))
        for _, lengths, symbols in self.batches(words):
            arcs = list(self.arcs(lengths, symbols))
            alpha = np.full((len(lengths), symbols.shape[1] + 1), -np.inf)
            alpha[:, 0] = 0
            for rows, i, j, w in arcs:
                alpha[rows, j] = np.logaddexp(alpha[rows, j], alpha[rows, i] + self.weights[w])
            beta = np.full_like(alpha, -np.inf)
            whole = np.arange(len(lengths)), lengths
            beta[whole] = 0
            for rows, i, j, w in reversed(arcs):
                through = self.weights[w] + beta[rows, j]
                beta[rows, i] = np.logaddexp(beta[rows, i], through)
                share = np.exp(alpha[rows, i] + through - alpha[rows, lengths[rows]])
                total += np.bincount(w, share, len(total))
        return total


def words_of(raw: bytes) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased."""
    return raw.lower().split()


def held_out(doc_id: Column) -> Column:
    """Whether a document is held out; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def sharpened(words: DataFrame, pieces, prior: np.ndarray) -> np.ndarray:
    """Log weights after one expectation step over the distinct `words`, the prior counting as one use a piece.

    What comes to the driver has a row for each piece, whatever the corpus.
    """
    shared = words.sparkSession.sparkContext.broadcast((pieces, prior))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        total = np.zeros(len(prior))
        for batch in batches:
            total += lattice.expected(batch.column("unit").to_pylist())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "uses"])

    rows = words.select("unit").mapInArrow(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
    found = rows.toArrow()
    uses = np.exp(prior) * len(prior)
    uses[found.column("piece").to_numpy()] += found.column("uses").to_numpy()
    return np.log(uses / uses.sum())


def scored_words(words: DataFrame, pieces, weights: np.ndarray, tokens: int, types: int) -> DataFrame:
    """`(unit, n, known, base, score, spelled)`: log10 probabilities of every distinct word, training count in `c`."""
    shared = words.sparkSession.sparkContext.broadcast((pieces, weights))
    mass = max(types, 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for batch in batches:
            c = batch.column("c").to_numpy(zero_copy_only=False).astype(np.float64)
            spelled = lattice.log_marginals(batch.column("unit").to_pylist())
            with np.errstate(divide="ignore"):
                model = np.logaddexp(np.log(c), math.log(mass) + spelled) - math.log(tokens + mass + 1)
            base = np.log10((c + BASE) / (tokens + BASE * (types + 1)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("unit"), batch.column("n"), pa.array(c > 0), pa.array(base),
                    pa.array(model / math.log(10)), pa.array(spelled / math.log(10)),
                ],
                ["unit", "n", "known", "base", "score", "spelled"],
            )

    return words.select("unit", "n", "c").mapInArrow(
        score, "unit binary, n long, known boolean, base double, score double, spelled double"
    )


def document_scores(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """`doc_id`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score`, `spelled_score` of every row.

    Scores are log10 probabilities of the whole text, a null one counting as empty: of its
    words and one end.  `base_score` adds counts, `score` is the lattice's with the arcs of known
    words, `spelled_score` that of pieces alone (without the end).  `docs` is a table; each row
    is a document, also with a null or repeated `doc_id`.  Without training rows the base is 0 and the
    pieces keep the vocabulary's weights.
    """
    spark = docs.sparkSession
    pieces, prior = pieces_of(open(model_path, "rb").read())
    source = docs.select(text_of(text).cast("binary").alias("text"), held_out(col("doc_id")).alias("flag"))
    counts = materialize(counted(source, words_of).withColumn("c", F.col("n") - F.col("n_flagged")), "words")
    trained = counts.where("c > 0")
    n_train = source.where("NOT flag").count()
    seen = trained.agg(F.sum("c").alias("tokens"), F.count("*").alias("types")).first()
    tokens, types = (seen.tokens or 0) + n_train, seen.types + (n_train > 0)
    weights = sharpened(trained, pieces, prior)
    scored = materialize(scored_words(counts, pieces, weights, tokens, types), "word-scores")
    limit = threshold(counts)
    table = scored.where(F.col("n") >= limit).toArrow().to_pydict()
    common = spark.sparkContext.broadcast(
        dict(zip(table["unit"], zip(table["known"], table["base"], table["score"], table["spelled"], strict=True), strict=True))
    )

    mass = max(types, 1)
    end = (
        n_train > 0,
        math.log10((n_train + BASE) / (tokens + BASE * (types + 1))),
        math.log10((n_train + 1) / (tokens + mass + 1)),
        0.0,
    )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value.get
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                rows: list[tuple] = []
                for row, doc, flag, raw in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    words = words_of(raw)
                    n_known, base, score, spelled = end
                    for w, n in Counter(words).items():
                        if (x := known(w)) is None:
                            rows.append((row, w, n, None))
                        else:
                            n_known += n * x[0]
                            base += n * x[1]
                            score += n * x[2]
                            spelled += n * x[3]
                    own = {"doc_id": doc, "held_out": flag, "n_tokens": len(words) + 1, "n_known": int(n_known),
                           "base": base, "score": score, "spelled": spelled}
                    # A key of its own, which no word equals as it holds a space.
                    rows.append((row, b" %d" % row, 0, own))
                a, b, c, d = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.binary()), pa.array(c, pa.int64()), pa.array(d, OWN)],
                    [ROW, "unit", "times", "own"],
                )

    rows = numbered(docs, col("doc_id").cast("long").alias("doc_id"), held_out(col("doc_id")).alias("flag"), text_of(text).cast("binary").alias("text"))
    parts = rows.mapInArrow(
        add_up,
        f"{ROW} long, unit binary, times long, own struct<doc_id:long,held_out:boolean,n_tokens:long,n_known:long,base:double,score:double,spelled:double>",
    )
    rest = scored.where(F.col("n") < limit).select("unit", "known", "base", "score", "spelled")
    joined = parts.join(rest, "unit", "left")

    def total(name: str) -> Column:
        return F.sum(F.coalesce(F.col(f"own.{name}"), F.col("times") * F.col(name), F.lit(0.0)))

    return (
        joined.groupBy(ROW)
        .agg(
            F.max("own.doc_id").alias("doc_id"),
            F.max("own.held_out").alias("held_out"),
            F.max("own.n_tokens").alias("n_tokens"),
            F.sum(F.coalesce(F.col("own.n_known"), F.when(F.col("known"), F.col("times")), F.lit(0))).alias("n_known"),
            total("base").alias("base_score"),
            total("score").alias("score"),
            total("spelled").alias("spelled_score"),
        )
        .select(
            "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
            "base_score", "score", "spelled_score",
        )
    )


OWN = pa.struct(
    [
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("base", pa.float64()), ("score", pa.float64()), ("spelled", pa.float64()),
    ]
)
