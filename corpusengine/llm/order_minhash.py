"""Near duplicates by order MinHash and banded alignment.

A text is the sequence of its five-word shingles, each labelled with its occurrence, so that no
label repeats.  A sketch takes the two shingles of least hash and keeps them in the order of the
text; two texts agree on it the likelier, the more shingles they share in the same order.
Two sketches make a band, and texts that agree on one of the bands are candidates.

A candidate pair is verified by alignment: `L` shingles in common order within the band around the
diagonal that a similar pair cannot leave, and `L / (n_a + n_b - L) >= 0.8`.  As labels do not repeat,
the longest common subsequence is a longest increasing one.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusengine.llm.common import ROW, col, numbered, text_of
from corpusengine.llm.components import components
from corpusengine.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at the threshold agrees on a sketch with odds of about 0.64, on a band of two with 0.41, on none of 16 with 2e-4.
BANDS, SKETCHES = 16, 2
#: Members of a bucket up to which open members are met pair by pair; texts of a block beyond.
SMALL_BUCKET, BLOCK = 16, 256
#: Distinct shingles of two blocks that are counted at once.
COLUMNS = 10_000
#: Ids that may be broadcast, 8 bytes each.
BROADCAST_IDS = 500_000
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, BANDS * SKETCHES, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def normal_words(raw: bytes) -> list[bytes]:
    return raw.decode("utf-8", "replace").lower().encode("utf-8", "replace").split()


def labelled_shingles(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the shingles with their occurrence numbers, in text order; a short text is one shingle."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    within = (np.arange(len(data)) - np.repeat(starts, lengths)).astype(np.uint64)
    ids = mixed(np.add.reduceat(mixed(data + np.uint64(257) * within + np.uint64(1)), starts))
    n, width = max(1, len(words) - SHINGLE + 1), min(SHINGLE, len(words))
    h = np.full(n, len(words) if width < SHINGLE else 0, np.uint64)
    for j in range(width):
        h = mixed(h * _ODD + ids[j : j + n])
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = (np.arange(n) - first).astype(np.uint64)
    return mixed(h + occurrence * _ODD)


def sketch(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`(keys, positions)` of the bands: a hash of the band's ordered shingles, and where its first one stands."""
    n, m = len(shingles), len(_SEEDS)
    places = np.empty((m, 2), np.int64)
    step = max(1, 200_000 // n)
    for i in range(0, m, step):
        seeds = _SEEDS[i : i + step, None]
        y = (shingles[None, :] ^ seeds) * seeds
        y ^= y >> np.uint64(29)
        rows = np.arange(len(y))
        places[i : i + step, 0] = y.argmin(axis=1)
        if n > 1:
            y[rows, places[i : i + step, 0]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        places[i : i + step, 1] = y.argmin(axis=1)
    places.sort(axis=1)
    values = shingles[places].reshape(BANDS, 2 * SKETCHES)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(values.shape[1]):
        keys = mixed(keys * _ODD + values[:, j])
    return keys.view(np.int64), places[::SKETCHES, 0]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Share of shingles in common order among all of both, 0 where it cannot reach `SIMILARITY`.

    `n_a + n_b - 2 L` shingles lie outside the alignment, for a similar pair at most a ninth of
    `n_a + n_b`; no aligned pair lies further from the diagonal than that.
    """
    total = len(a) + len(b)
    band = total * (1 - SIMILARITY) / (1 + SIMILARITY)
    if abs(len(a) - len(b)) > band:
        return 0.0
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(at_a - at_b) <= band
    at_a, at_b = at_a[near], at_b[near]
    if len(at_a) < SIMILARITY / (1 + SIMILARITY) * total - 1e-9:
        return 0.0
    tails: list[int] = []
    for x in at_b[np.argsort(at_a)].tolist():
        if not tails or x > tails[-1]:
            tails.append(x)
        else:
            tails[bisect_left(tails, x)] = x
    return len(tails) / (total - len(tails))


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """`(ROW, doc_id, digest, n, bands)` of every row; `bands` is empty for a text without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, bands = [], [], []
            for row, value in zip(batch.column(0), batch.column(2), strict=True):
                words = normal_words(value.as_py())
                raw = b" ".join(words) if words else b" %d" % row.as_py()
                digests.append(hashlib.blake2b(raw, digest_size=16).digest())
                sizes.append(0)
                bands.append([])
                if words:
                    shingles = labelled_shingles(words)
                    keys, places = sketch(shingles)
                    sizes[-1] = len(shingles)
                    bands[-1] = [{"key": k, "at": p} for k, p in zip(keys.tolist(), places.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                    pa.array(bands, pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int64())]))),
                ],
                [ROW, "doc_id", "digest", "n", "bands"],
            )

    rows = numbered(docs, col("doc_id").cast("long").alias("doc_id"), text_of(text).cast("binary").alias("text"))
    kinds = f"{ROW} long, doc_id long, digest binary, n long, bands array<struct<key:long,at:long>>"
    return rows.mapInArrow(run, kinds)


def verified(docs: DataFrame, pairs: DataFrame, text: str = "text") -> DataFrame:
    """The pairs `(a, b)` of row numbers that are similar, with their `similarity`.

    Only texts in a pair are moved; their ids are broadcast when they are counted to be few.
    """
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias(ROW)).distinct(), "paired-rows")
    few = ids.count() <= BROADCAST_IDS
    texts = numbered(docs, text_of(text).cast("binary").alias("text")).join(F.broadcast(ids) if few else ids, ROW, "left_semi")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_shingles = None, None
        for batch in batches:
            similar = []
            for b, text_a, text_b in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                if last != b.as_py():  # pairs come ordered by their second text
                    last, last_shingles = b.as_py(), labelled_shingles(normal_words(text_b.as_py()))
                similar.append(similarity(labelled_shingles(normal_words(text_a.as_py())), last_shingles))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similar, pa.float64())], ["a", "b", "similarity"])

    with_a = pairs.join(texts.select(F.col(ROW).alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col(ROW).alias("b"), F.col("text").alias("text_b")), "b")
    aligned = with_b.select("a", "b", "text_a", "text_b").mapInArrow(align, "a long, b long, similarity double")
    return aligned.where(F.col("similarity") >= SIMILARITY)


def _shingles(texts) -> list[np.ndarray]:
    return [labelled_shingles(normal_words(t)) for t in texts]


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Shingles that each text of `left` has in common with each of `right`; at most a block of each."""
    sizes = [len(x) for x in left] + [len(x) for x in right]
    values, ids = np.unique(np.concatenate(left + right), return_inverse=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    on_left = owner < len(left)
    both = np.zeros(len(values), bool)
    both[ids[on_left]] = True
    seen = np.zeros(len(values), bool)
    seen[ids[~on_left]] = True
    number = np.cumsum(both & seen) - 1
    keep = (both & seen)[ids]
    owner, ids = owner[keep], number[ids[keep]]
    counts = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(ids.max(initial=-1)) + 1, COLUMNS):
        here = (ids >= start) & (ids < start + COLUMNS)
        table = np.zeros((len(sizes), COLUMNS), np.float32)
        table[owner[here], ids[here] - start] = 1
        counts += table[: len(left)] @ table[len(left) :].T
    return counts


def _compare(key, own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """Similar pairs of different classes, one of each block."""
    found = []
    if len(own) and len(others):
        left, right = _shingles(own["text"]), _shingles(others["o_text"])
        total = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
        hopeful = common_counts(left, right) >= SIMILARITY / (1 + SIMILARITY) * total - 1e-3
        hopeful &= own["label"].to_numpy()[:, None] != others["o_label"].to_numpy()[None, :]
        found = [
            (own["id"].iloc[i], others["o_id"].iloc[j])
            for i, j in zip(*np.nonzero(hopeful), strict=True)
            if similarity(left[i], right[j]) >= SIMILARITY
        ]
    return pd.DataFrame({"a": [min(p) for p in found], "b": [max(p) for p in found]}, dtype="int64")


def _in_blocks(docs: DataFrame, members: DataFrame, text: str) -> DataFrame:
    """Similar pairs of open members with members of other classes in large buckets, block against block.

    A bucket is dealt over blocks of about `BLOCK` texts, so no task holds more than two blocks, and
    only similar pairs leave it.
    """
    sizes = members.groupBy("key").agg(
        F.ceil(F.sum(F.col("open").cast("int")) / BLOCK).cast("int").alias("rows"), F.ceil(F.count("*") / BLOCK).cast("int").alias("columns")
    )
    ids = materialize(members.select(F.col("id").alias(ROW)).distinct(), "block-rows")
    few = ids.count() <= BROADCAST_IDS
    texts = numbered(docs, text_of(text).cast("binary").alias("text")).join(F.broadcast(ids) if few else ids, ROW, "left_semi")
    placed = members.join(sizes, "key").withColumn("spot", F.xxhash64("id", "key"))

    def dealt(side: DataFrame, row, column) -> DataFrame:
        return side.select("key", row.alias("row"), column.alias("column"), "id", "label").join(
            texts.withColumnRenamed(ROW, "id"), "id"
        )

    own = dealt(
        placed.where("open").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))),
        F.pmod("spot", "rows").cast("int"), F.col("j"),
    )
    others = dealt(
        placed.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))), F.col("i"), F.pmod("spot", "columns").cast("int")
    ).select("key", "row", "column", F.col("id").alias("o_id"), F.col("label").alias("o_label"), F.col("text").alias("o_text"))
    others = others.toDF("o_key", "o_row", "o_column", "o_id", "o_label", "o_text")
    grouped = own.groupBy("key", "row", "column").cogroup(others.groupBy("o_key", "o_row", "o_column"))
    return grouped.applyInPandas(_compare, "a long, b long")


def near_links(docs: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """Similar pairs `(a, b)` that connect the classes of `texts` `(ROW, n, bands)`, all of them different texts.

    First every bucket's head is compared with its other members.  The head is the member that
    meets most others; of a group of edited copies that is mostly their origin, so a
    large group costs one pair a membership.  Members that are not of the head's class
    then, the open ones, are compared with all members of other classes: as pairs in small
    buckets, block against block in large ones.  As two members of the head's class need no
    comparison, no pair of a bucket is left out.
    """
    members = texts.select(F.col(ROW).alias("id"), "n", F.explode("bands").alias("band")).select(
        "id", "n", F.col("band.key").alias("key"), F.col("band.at").alias("at")
    )
    shared = materialize(members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = members.join(shared, "key")
    meets = members.groupBy("id").agg(F.sum("size").alias("meets"))
    first = F.struct(-F.col("meets"), F.col("id"))
    members = materialize(members.join(meets, "id"), "members")
    heads = materialize(members.groupBy("key").agg(F.min_by(F.struct("id", "n", "at"), first).alias("head")), "heads")
    reach = (1 - SIMILARITY) / (1 + SIMILARITY)

    def may_align(n: str, at: str, other_n: str, other_at: str) -> Column:
        most = (F.col(n) + F.col(other_n)) * reach
        return (F.abs(F.col(n) - F.col(other_n)) <= most) & (F.abs(F.col(at) - F.col(other_at)) <= most)

    def pair(a: str, b: str) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    stars = members.join(heads, "key").where((F.col("id") != F.col("head.id")) & may_align("n", "at", "head.n", "head.at"))
    pairs = materialize(stars.select(*pair("id", "head.id")).distinct(), "star-pairs")
    links = materialize(verified(docs, pairs, text).select("a", "b"), "star-links")

    labels = components(links)
    labelled = members.join(labels, "id", "left").select("key", "id", "n", "at", "size", F.coalesce("label", "id").alias("label"))
    labelled = materialize(labelled, "labelled")
    of_head = heads.select("key", F.col("head.id").alias("id")).join(labelled, ["key", "id"]).select("key", F.col("id").alias("head"), F.col("label").alias("head_label"))
    # The head has met all of its bucket.
    rest = labelled.join(of_head, "key").where(F.col("id") != F.col("head")).withColumn("open", F.col("label") != F.col("head_label"))
    with_open = rest.groupBy("key").agg(F.max("open").alias("any"), F.min("label").alias("low"), F.max("label").alias("high"))
    rest = rest.join(with_open.where("any AND low < high").select("key"), "key", "left_semi")
    rest = materialize(rest.select("key", "id", "n", "at", "size", "label", "open"), "open-buckets")

    small = rest.where(F.col("size") <= SMALL_BUCKET)
    other = small.select("key", F.col("id").alias("o_id"), F.col("n").alias("o_n"), F.col("at").alias("o_at"), F.col("label").alias("o_label"))
    met = (
        small.where("open").join(other, "key")
        .where((F.col("label") != F.col("o_label")) & may_align("n", "at", "o_n", "o_at"))
        .select(*pair("id", "o_id")).distinct().join(pairs, ["a", "b"], "left_anti")
    )
    more = verified(docs, materialize(met, "small-pairs"), text).select("a", "b")
    blocks = _in_blocks(docs, rest.where(F.col("size") > SMALL_BUCKET), text)
    return links.unionByName(materialize(more.unionByName(blocks).distinct(), "more-links"))


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """`(ROW, doc_id, class_id, first)` of every row: the `doc_id` of its class's first row, and whether it is that row.

    Rows rank by `doc_id`, nulls last, then by place in the table, which `docs` has to be.  Texts with
    equal words are one text from the start, also as a third of all rows; a text without a word
    is a class of its own.
    """
    rows = materialize(sketches(docs, text), "sketches")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW)
    texts = materialize(
        rows.groupBy("digest")
        .agg(F.min(F.struct(rank.alias("rank"), "n", "bands")).alias("least"))
        .select("digest", F.col("least.rank").alias("rank"), F.col(f"least.rank.{ROW}").alias(ROW), "least.n", "least.bands"),
        "distinct-texts",
    )
    labels = components(near_links(docs, texts, text))
    labelled = texts.join(labels.withColumnRenamed("id", ROW), ROW, "left").select(
        "digest", "rank", F.coalesce("label", ROW).alias("label")
    )
    firsts = labelled.groupBy("label").agg(F.min("rank").alias("first"))
    of_digest = labelled.join(firsts, "label").select("digest", "first")
    return rows.select(ROW, "doc_id", "digest").join(of_digest, "digest").select(
        ROW, "doc_id", F.col("first.doc_id").alias("class_id"), (F.col(ROW) == F.col(f"first.{ROW}")).alias("first")
    )


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """The first row of every class, with the columns of `docs`."""
    dropped = classes(docs, text).where("NOT first").select(ROW)
    whole = numbered(docs, F.struct(*[col(c) for c in docs.columns]).alias("doc"))
    return whole.join(dropped, ROW, "left_anti").select("doc.*")
