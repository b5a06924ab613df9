"""Phrase collocations by best-first branch-and-bound growth.

Phrases grow word by word from their prefixes.  A phrase is no more frequent than its parts, so

* a phrase that occurs often enough has only words and pairs that do, and
* a phrase grown from the prefix `x y` scores at most `f(x y) / f(x)`, because its own count
  cancels against the larger count of the rest in the cut after `x`.

Words and the pairs of frequent words are counted first.  The pairs are the frontier, best bound first:
a round expands, in every language that is not settled, all prefixes whose bound reaches a threshold,
and all pairs that reach it by their own score (a longer phrase may drop them).  A language is
settled when its `top`-th surviving score is not below the threshold, so that no prefix left could tie.
Else the `top`-th best survivor known so far is the next threshold, which settles it, or, while there are
too few survivors, a larger part of the frontier is expanded.

Each pass reads the corpus once.  Tasks count what they read before the shuffle.  What they may skip
they learn from bit maps of the prefixes' hashes; a hash that collides costs work and never changes a
count.  The maps grow with the number of prefixes up to `most_bits`; beyond that more is counted in vain.

A null text is empty, a null language `und`.  Every row counts, repeated ones too, and texts of any length are
counted in blocks.  An empty table has no phrases.  Other columns play no part.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusengine.llm.common import col, text_of
from corpusengine.session import materialize

TOP = 2000
LEAST = 10
#: A phrase goes if a longer one holds it in at least so many percent of its occurrences.
OVERLAP_PERCENT = 50
SCALE = 1_000_000
#: The first round expands this many times `TOP` prefixes of a language; later rounds without enough survivors `WIDER` times more.
FIRST, WIDER = 8, 4
#: Bits of a map for every key, and at most.
BITS_PER_KEY, PROBES, MOST_BITS = 12, 4, 1 << 28
#: Bytes of a text that are split at a time; words, and packed phrases, that a task holds before it sends its counts on.
BLOCK, WORDS, PHRASES = 1 << 20, 1 << 19, 1 << 20
#: Bits of a word's number within a task, so that three fit into 64.
ID_BITS = 21

# Ends of pieces become full stops, tabs spaces, and A-Z is lower-cased.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_TABLE = bytes.maketrans(_ENDS + b"\t" + _UPPER, b"." * len(_ENDS) + b" " + _UPPER.lower())
_COUNTS = "lang string, phrase string, n long"


def blocks(text: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text in order, with `.` at every end of a piece, for about `size` bytes at a time."""
    text = text.translate(_TABLE)
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            stops = [p for p in (text.find(b" ", end), text.find(b".", end)) if p >= 0]
            end = min(stops) if stops else len(text)
        yield text[at:end].replace(b".", b" . ").split()
        at = end


# --- bit maps -------------------------------------------------------------------------------------


@dataclass
class BitMap:
    """A set of 64-bit hashes that may hold more than was put in, never less."""

    words: np.ndarray
    mask: int

    def __contains__(self, key: int) -> bool:
        low, high = key & 0xFFFFFFFF, key >> 32 | 1
        return all(int(self.words[p >> 6]) >> (p & 63) & 1 for p in ((low + i * high) & self.mask for i in range(PROBES)))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        low, high = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
        left = np.arange(len(keys))
        for i in range(PROBES):
            p = (low[left] + np.uint64(i) * high[left]) & np.uint64(self.mask)
            left = left[(self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) != 0]
        found = np.zeros(len(keys), bool)
        found[left] = True
        return found


def bit_map(keys: DataFrame, most_bits: int = MOST_BITS) -> BitMap:
    """The map of the long column `key`: built on the executors, at most `most_bits` bits on the driver."""
    n = keys.count()
    bits = 64
    while bits < min(n * BITS_PER_KEY, most_bits):
        bits *= 2
    low, high = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("key", 32).bitwiseOR(F.lit(1))
    places = [(low + i * high).bitwiseAND(F.lit(bits - 1)) for i in range(PROBES)]
    placed = keys.select(F.explode(F.array(*places)).alias("p"))
    one = F.expr("shiftleft(1L, cast(p & 63 as int))")
    packed = placed.groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(one).alias("word")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[packed["at"].to_numpy()] = packed["word"].to_numpy().view(np.uint64)
    return BitMap(words, bits - 1)


def word_key(lang: Column, word: Column) -> Column:
    return F.xxhash64(lang, word)


def pair_key(lang: Column, first: Column, second: Column) -> Column:
    return F.xxhash64(word_key(lang, first), word_key(lang, second))


def _hash_longs(keys: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's `xxhash64` of a long column after what gave `seed`."""
    p1, p2, p3, p4, p5 = (
        np.uint64(x)
        for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
    )
    turn = lambda x, by: (x << np.uint64(by)) | (x >> np.uint64(64 - by))
    h = seed + p5 + np.uint64(8)
    h ^= turn(keys * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _hash_longs(second, _hash_longs(first, np.full(len(first), 42, np.uint64)))


# --- counting -------------------------------------------------------------------------------------


class _Vocabulary(dict):
    """Numbers of the words of a language that are in the map; 0 for all others and for ends of pieces."""

    def __init__(self, lang: str, known: BitMap):
        super().__init__()
        self.seed, self.known = xxhash.xxh64_intdigest(lang.encode(), 42), known
        self.words, self.hashes = [b""], array("Q", [0])
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        key = xxhash.xxh64_intdigest(word, self.seed)
        number = 0
        if key in self.known:
            number = len(self.words)
            self.words.append(word)
            self.hashes.append(key)
        self[word] = number
        return number


class _Packed:
    """Counts of phrases packed into 64 bits."""

    def __init__(self):
        self.new, self.size = [], 0
        self.codes, self.n = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, codes: np.ndarray) -> None:
        if len(codes):
            self.new.append(codes)
            self.size += len(codes)
        if self.size > PHRASES:
            self.merge()

    def merge(self) -> None:
        if self.new:
            codes, n = np.unique(np.concatenate(self.new), return_counts=True)
            both, at = np.unique(np.concatenate([self.codes, codes]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, at, np.concatenate([self.n, n]))
            self.codes, self.n, self.new, self.size = both, total, [], 0


def _batch(lang: str, phrases: pa.Array, n: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), phrases, n], ["lang", "phrase", "n"])


def _count_words(rows: Iterator[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, words in seen.items():
            words.pop(b".", None)
            # The empty phrase stands for all words.
            words[b""] = sum(words.values())
            yield _batch(lang, pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64()))
        seen.clear()

    for lang, text in rows:
        words = seen.setdefault(lang, Counter())
        for block in blocks(text):
            words.update(block)
        if sum(map(len, seen.values())) > WORDS:
            yield from flush()
    yield from flush()


def _counting(size: int, known: BitMap, wanted: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """Counts the phrases of `size` words in the map; `wanted` gets the words' hashes and picks among the phrases' starts."""

    def count(rows: Iterator[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[_Vocabulary, _Packed]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (vocabulary, packed) in seen.items():
                packed.merge()
                words = pa.array(vocabulary.words, pa.string())
                for at in range(0, len(packed.codes), PHRASES // 2):
                    codes = packed.codes[at : at + PHRASES // 2]
                    parts = [words.take(pa.array((codes >> (ID_BITS * (size - 1 - i))) & ((1 << ID_BITS) - 1))) for i in range(size)]
                    yield _batch(lang, pc.binary_join_element_wise(*parts, " "), pa.array(packed.n[at : at + len(codes)]))
            seen.clear()

        for lang, text in rows:
            if lang not in seen:
                seen[lang] = _Vocabulary(lang, known), _Packed()
            vocabulary, packed = seen[lang]
            before: list[int] = []
            for block in blocks(text):
                # Phrases over the end of a block count in the next one, which begins with the words before it.
                numbers = np.array([*before, *map(vocabulary.__getitem__, block)], np.int64)
                before = numbers[-(size - 1) :].tolist()
                starts = len(numbers) - size + 1
                if starts < 1:
                    continue
                inside = np.ones(starts, bool)
                for i in range(size):
                    inside &= numbers[i : starts + i] > 0
                at = np.flatnonzero(inside)
                if size > 2 and len(at):
                    hashes = np.frombuffer(vocabulary.hashes, np.uint64)
                    at = at[wanted(*[hashes[numbers[at + i]] for i in range(size)])]
                    del hashes  # the vocabulary cannot grow while its buffer is in use
                code = np.zeros(len(at), np.int64)
                for i in range(size):
                    code = (code << ID_BITS) | numbers[at + i]
                packed.add(code)
            if sum(len(v) for v, _ in seen.values()) > WORDS or sum(p.size + len(p.codes) for _, p in seen.values()) > 3 * PHRASES:
                yield from flush()
        yield from flush()

    return count


def _counted(texts: DataFrame, count: Callable) -> DataFrame:
    """`(lang, phrase, n)` over the corpus from what `count` yields in each task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                yield lang.as_py(), text.as_py()

    return (
        texts.mapInArrow(lambda batches: count(rows(batches)), _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    )


# --- scores ---------------------------------------------------------------------------------------


def _score(a: str, left: str, right: str) -> Column:
    """`floor(SCALE * a * a / (left * right))` in decimals of 38 digits."""
    d = lambda name: f"cast({name} as decimal(18,0))"
    return F.expr(f"cast(cast({SCALE} as decimal(7,0)) * {d(a)} as decimal(20,0)) * {d(a)} div ({d(left)} * {d(right)})")


def _word(n: int) -> Column:
    return F.split("phrase", " ")[n]


def scored_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """`(lang, phrase, a, l, r, score, bound)`; `bound` is the most that a phrase grown from the pair may score."""
    first = words.select("lang", F.col("phrase").alias("x"), F.col("n").alias("l"))
    second = words.select("lang", F.col("phrase").alias("y"), F.col("n").alias("r"))
    joined = (
        pairs.select("lang", "phrase", F.col("n").alias("a"), _word(0).alias("x"), _word(1).alias("y"))
        .join(first, ["lang", "x"])
        .join(second, ["lang", "y"])
    )
    bound = F.expr(f"cast(a as decimal(18,0)) * {SCALE} div l")
    return joined.select("lang", "phrase", "a", "l", "r", _score("a", "l", "r").alias("score"), bound.alias("bound"))


def scored_triples(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """`(lang, phrase, head, tail, a, l, r, score)` by the lowest-scoring cut, the first of equal ones."""
    heads = pairs.select("lang", F.col("phrase").alias("head"), F.col("a").alias("head_n"), F.col("l").alias("x_n"))
    tails = pairs.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("tail_n"), F.col("r").alias("z_n"))
    joined = (
        triples.select(
            "lang", "phrase", F.col("n").alias("a"), F.concat_ws(" ", _word(0), _word(1)).alias("head"), F.concat_ws(" ", _word(1), _word(2)).alias("tail")
        )
        .join(heads, ["lang", "head"])
        .join(tails, ["lang", "tail"])
        .withColumn("one", _score("a", "x_n", "tail_n"))
        .withColumn("two", _score("a", "head_n", "z_n"))
    )
    early = F.col("one") <= F.col("two")
    return joined.select(
        "lang",
        "phrase",
        "head",
        "tail",
        "a",
        F.when(early, F.col("x_n")).otherwise(F.col("head_n")).alias("l"),
        F.when(early, F.col("tail_n")).otherwise(F.col("z_n")).alias("r"),
        F.least("one", "two").alias("score"),
    )


def reached(values: DataFrame, rank: int) -> DataFrame:
    """`(lang, theta)`: the largest value that at least `rank` rows of the language reach; no row if there are fewer.

    `values` is `(lang, value)`, integers up to `SCALE`, so a language has a bounded number of different ones.
    """
    best_first = W.partitionBy("lang").orderBy(F.desc("value"))
    counts = values.groupBy("lang", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("n", F.sum("n").over(best_first)).where(F.col("n") >= rank).groupBy("lang").agg(F.max("value").alias("theta"))


def _survivors(pairs: DataFrame, triples: DataFrame, theta: DataFrame, overlap: int) -> DataFrame:
    """What is known to survive: all triples, and the pairs from `theta` on that no longer phrase drops."""
    holders = triples.select("lang", F.explode(F.array("head", "tail")).alias("phrase"), F.col("a").alias("longer"))
    holders = holders.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    settled = (
        pairs.join(theta, "lang")
        .where("score >= theta")
        .join(holders, ["lang", "phrase"], "left")
        .where(F.col("longer").isNull() | (100 * F.col("longer") < overlap * F.col("a")))
    )
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    return settled.select(columns).unionByName(triples.select(columns))


def _ranked(phrases: DataFrame, top: int, parts: int = 256) -> DataFrame:
    """The first `top` of every language; its phrases are cut to `top` in `parts` groups before they meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for keys in (["lang", "part"], ["lang"]):
        phrases = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
        phrases = phrases.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return phrases.withColumn("rank", F.col("rank").cast("long")).drop("part")


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    top: int = TOP,
    least: int = LEAST,
    overlap: int = OVERLAP_PERCENT,
    first: int = FIRST,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """`(lang, rank, phrase, a, l, r, n, score)`: the best phrases of 2 or 3 words of every language."""
    texts = docs.select(
        F.coalesce(col(lang).cast("string"), F.lit("und")).alias("lang"), text_of(text).cast("binary").alias("text")
    )
    context = docs.sparkSession.sparkContext
    counts = materialize(_counted(texts, _count_words).where((F.col("n") >= least) | (F.col("phrase") == "")), "word-counts")
    words, totals = counts.where("phrase <> ''"), counts.where("phrase = ''").select("lang", "n")

    known = context.broadcast(bit_map(words.select(word_key(F.col("lang"), F.col("phrase")).alias("key")), most_bits))
    counted = _counted(texts, lambda rows: _counting(2, known.value, None)(rows)).where(F.col("n") >= least)
    pairs = materialize(scored_pairs(materialize(counted, "pair-counts"), words), "pairs")
    keys = pair_key(F.col("lang"), _word(0), _word(1)).alias("key")
    frequent = context.broadcast(bit_map(pairs.select(keys), most_bits))

    bounds, rank = pairs.select("lang", F.col("bound").alias("value")), first * top
    # `above` is the threshold of the round before: what reaches it is expanded already.
    theta = totals.select("lang", F.lit(SCALE + 1).alias("above")).join(reached(bounds, rank), "lang", "left")
    theta = materialize(theta.select("lang", "above", F.coalesce("theta", F.lit(0)).cast("long").alias("theta")), "thresholds")
    settled, triples = theta.limit(0).select("lang", "theta"), None
    while True:
        near = pairs.join(F.broadcast(theta), "lang")
        contend = (F.col("score") >= F.col("theta")) & (F.col("score") < F.col("above"))
        grow = contend | ((F.col("bound") >= F.col("theta")) & (F.col("bound") < F.col("above")))
        heads = context.broadcast(bit_map(near.where(grow).select(keys), most_bits))
        tails = context.broadcast(bit_map(near.where(contend).select(keys), most_bits))

        def wanted(x: np.ndarray, y: np.ndarray, z: np.ndarray, heads=heads, tails=tails) -> np.ndarray:
            head, tail = pair_hashes(x, y), pair_hashes(y, z)
            picked = heads.value.holds(head) | tails.value.holds(tail)
            picked[picked] = frequent.value.holds(head[picked]) & frequent.value.holds(tail[picked])
            return picked

        found = _counted(texts, lambda rows, wanted=wanted: _counting(3, known.value, wanted)(rows))
        found = scored_triples(materialize(found.where(F.col("n") >= least), "triple-counts"), pairs)
        # A phrase found by its head in one round and by its tail in another has the same count in both.
        triples = materialize((found if triples is None else triples.unionByName(found)).dropDuplicates(["lang", "phrase"]), "triples")

        unsettled = materialize(_survivors(pairs, triples, theta.select("lang", "theta"), overlap).join(F.broadcast(theta), "lang"), "survivors")
        enough = unsettled.where("score >= theta").groupBy("lang").agg(F.count("*").alias("n"))
        judged = materialize(
            theta.join(enough, "lang", "left").join(
                reached(unsettled.select("lang", F.col("score").alias("value")), top).withColumnRenamed("theta", "known"), "lang", "left"
            ),
            "judged",
        )
        done = (F.coalesce("n", F.lit(0)) >= top) | (F.col("theta") == 0)
        settled = materialize(settled.unionByName(judged.where(done).select("lang", "theta")), "settled")
        left = judged.where(~done).select("lang", F.col("theta").alias("above"), "known")
        if left.isEmpty():
            break
        rank *= WIDER
        wider = reached(bounds, rank)
        following = F.least(F.coalesce("known", "theta", F.lit(0)), F.col("above") - 1).cast("long")
        theta = materialize(left.join(wider, "lang", "left").select("lang", "above", following.alias("theta")), "thresholds")

    best = _survivors(pairs, triples, settled, overlap).join(F.broadcast(settled), "lang").where("score >= theta").drop("theta")
    return _ranked(best, top).join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
