"""Exact and near-duplicate removal, first occurrence wins.

The order is explicit: (document, sentence position).  A text shorter than `min_len` is
never registered, so its repeats survive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusengine.functions.arrays import explode_rows, first_occurrences, let
from corpusengine.functions.arrow import minhash
from corpusengine.functions.text import collapse, is_blank, is_unsafe, mask_pii, nfkc, sentences
from corpusengine.operators.sequences import with_dense_id
from corpusengine.session import materialize

MIN_LEN = 20
THRESHOLD = 0.85
SPLIT_BUCKETS_ABOVE = 100
HEADS = 32


def exact_sentences(
    docs: DataFrame, sents: str = "sentences", min_len: int = MIN_LEN, per_document: bool = False
) -> DataFrame:
    """Surviving sentences `(doc_id, pos, sentence)` of documents with a sentence array.

    Repeats inside a document vanish before the shuffle.  Across documents one
    aggregation with map-side combine finds the first holder; a sentence that fills a
    third of the corpus is reduced to one row per task first.
    """
    def survivors(s: Column) -> Column:
        indexed = F.transform(s, lambda v, i: F.struct(v.alias("v"), i.alias("at")))
        short = F.filter(indexed, lambda x: F.length(x["v"]) < min_len)
        return F.concat(short, F.filter(first_occurrences(s), lambda x: F.length(x["v"]) >= min_len))

    rows = explode_rows(docs, ["doc_id"], let(F.col(sents), survivors), "_i", "x").select(
        "doc_id", F.col("x.at").cast("bigint").alias("pos"), F.col("x.v").alias("sentence")
    )
    if per_document:
        return rows
    free = F.length("sentence") < min_len
    return (
        rows.groupBy(
            "sentence",
            F.when(free, F.col("doc_id")).alias("_own_doc"),
            F.when(free, F.col("pos")).alias("_own_pos"),
        )
        .agg(F.min("doc_id").alias("doc_id"), F.min_by("pos", "doc_id").alias("pos"))
        .select("doc_id", "pos", "sentence")
    )


def exact(df: DataFrame, text: str, order: list[str], min_len: int = MIN_LEN) -> DataFrame:
    """First row of every distinct `text` of at least `min_len` characters, and all shorter rows."""
    free = F.length(text) < min_len
    rest = [c for c in df.columns if c != text and c not in order]
    firsts = df.groupBy(
        text, *[F.when(free, F.col(c)).alias(f"_own_{c}") for c in order]
    ).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return firsts.select(*[F.col(text) if c == text else F.col(f"_first.{c}").alias(c) for c in df.columns])


def signatures(df: DataFrame, text: str, perms: int = 64, shingle: int = 5) -> DataFrame:
    """Adds `signature`; null when the text has no shingle."""
    return df.withColumn("signature", minhash(perms, shingle)(F.col(text)))


def required_matches(perms: int, threshold: float) -> int:
    return math.ceil(perms * threshold - 1e-9)


def _bands(positions: list[int], count: int) -> list[list[int]]:
    return [positions[i::count] for i in range(count)]


def _values(positions: list[int]) -> list[Column]:
    return [F.get("signature", F.lit(p)) for p in positions]


def band_buckets(items: DataFrame, perms: int = 64, threshold: float = THRESHOLD, scope: tuple[str, ...] = ()) -> DataFrame:
    """Bucket memberships `(id, signature, band, bucket)` that join every pair above the threshold.

    A pair differs in at most `d` positions, so of `d + 1` bands one is equal.
    """
    return items.select("id", "signature", F.posexplode(_band_keys(perms, threshold, scope)).alias("band", "bucket"))


def _band_keys(perms: int, threshold: float, scope: tuple[str, ...]) -> Column:
    count = perms - required_matches(perms, threshold) + 1
    return F.array(*[F.xxhash64(*scope, F.lit(b), *_values(p)) for b, p in enumerate(_bands(list(range(perms)), count))])


def _shared_buckets(memberships: DataFrame) -> DataFrame:
    """The memberships of buckets with two members or more, written.

    Counted in a window, so that memberships are moved once; the window of a crowded bucket spills.
    """
    counted = memberships.withColumn("_n", F.count("*").over(W.partitionBy("bucket")))
    return materialize(counted.where("_n > 1").drop("_n"), "shared-buckets")


def _divide_crowded(
    memberships: DataFrame, signature: DataFrame, perms: int, threshold: float
) -> DataFrame:
    """Memberships `(id, band, bucket)` with the members of crowded buckets in finer ones.

    A bucket's members share one band; a pair above the threshold differs in at most `d` of
    the other positions, so of `d + 1` finer bands over them one is equal.  Nothing is lost.
    """
    sizes = memberships.groupBy("bucket").agg(F.count("*").alias("n"))
    crowded = materialize(sizes.where(F.col("n") > SPLIT_BUCKETS_ABOVE).select("bucket"), "crowded-buckets")
    if crowded.isEmpty():
        return memberships
    count = perms - required_matches(perms, threshold) + 1
    finer = []
    for b, positions in enumerate(_bands(list(range(perms)), count)):
        rest = [p for p in range(perms) if p not in set(positions)]
        keys = [F.xxhash64("bucket", F.lit(j), *_values(p)) for j, p in enumerate(_bands(rest, count))]
        finer.append(F.when(F.col("band") == b, F.array(*keys)))
    moved = (
        memberships.join(crowded, "bucket", "left_semi")
        .join(signature, "id")
        .select("id", "band", F.explode(F.coalesce(*finer)).alias("bucket"))
    )
    return memberships.join(crowded, "bucket", "left_anti").select("id", "band", "bucket").unionByName(moved)


def _agreement(a: str, b: str) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def near_duplicates(
    items: DataFrame, perms: int = 64, threshold: float = THRESHOLD, scope: tuple[str, ...] = ()
) -> DataFrame:
    """Dropped items `(id, keeper, matches)` of a greedy pass in the order of the integer `id`.

    An item is dropped iff an earlier kept item agrees with it on `threshold` of the
    signature.  `items`: id, signature and the columns `scope` that pairs must share.

    Each round compares the first members of every bucket, its heads, with the later ones.
    An item that is a head in all its buckets has met every earlier candidate; if it is
    similar to none of them it is kept, and what is similar to a kept item is dropped.
    The others go to the next round.  The first round has one head per bucket, so a
    cluster of copies costs one pair per membership however large it is.  Buckets still
    crowded after it are divided, and the number of heads then doubles from round to round.

    `items` is read twice, the second time for what shares a bucket only: give a table, or columns made
    from one inside the row.
    """
    need = required_matches(perms, threshold)
    items = items.select("id", "signature", *scope)
    # A filter on the signature would work it out once more.
    signed = F.when(F.col("signature").isNotNull(), _band_keys(perms, threshold, scope))
    keys = materialize(items.select("id", signed.alias("keys")), "band-keys")
    members = _shared_buckets(keys.select("id", F.posexplode("keys").alias("band", "bucket")))
    if members.isEmpty():
        return items.sparkSession.createDataFrame([], "id BIGINT, keeper BIGINT, matches INT")
    # Only what shares a bucket is compared: most signatures are made, used for the buckets and never moved.
    sharing = materialize(members.select("id").distinct(), "sharing")
    signature = materialize(items.join(sharing, "id", "left_semi").select("id", "signature"), "signatures")
    later = signature.select(F.col("id").alias("keeper"), F.col("signature").alias("kept_signature"))
    in_order = W.partitionBy("bucket").orderBy("id")
    dropped = None
    heads_per_bucket = 1
    while True:
        shared = members
        heads = (
            shared.select("bucket", "id")
            .withColumn("_nth", F.row_number().over(in_order))
            .where(F.col("_nth") <= heads_per_bucket)
            .select("bucket", F.col("id").alias("keeper"))
        )
        edges = materialize(
            shared.join(heads, "bucket")
            .where(F.col("keeper") < F.col("id"))
            .select("id", "keeper")
            .distinct()
            .join(signature, "id")
            .join(later, "keeper")
            .select("id", "keeper", _agreement("signature", "kept_signature").alias("matches"))
            .where(F.col("matches") >= need),
            "near-pairs",
        )
        places = shared.groupBy("id").agg(F.count("*").alias("n"))
        leading = heads.groupBy(F.col("keeper").alias("id")).agg(F.count("*").alias("n"))
        kept = materialize(
            places.join(leading, ["id", "n"], "left_semi").join(edges, "id", "left_anti").select("id"), "kept"
        )
        out = (
            edges.join(kept.select(F.col("id").alias("keeper")), "keeper", "left_semi")
            .groupBy("id")
            .agg(F.min("keeper").alias("keeper"), F.min_by("matches", "keeper").alias("matches"))
        )
        dropped = out if dropped is None else dropped.unionByName(out)
        settled = kept.unionByName(out.select("id"))
        members = shared.join(settled, "id", "left_anti")
        if heads_per_bucket == 1:
            members = _divide_crowded(materialize(members, "memberships"), signature, perms, threshold)
            heads_per_bucket = HEADS
        else:
            heads_per_bucket *= 2
        members = _shared_buckets(members)
        if members.isEmpty():
            return dropped


def clean_sentences(
    docs: DataFrame, text: str = "text", near: bool = True, per_document: bool = False,
    min_len: int = MIN_LEN, threshold: float = THRESHOLD, perms: int = 64,
) -> DataFrame:
    """Guarded, masked sentences `(doc_id, pos, sentence)` without repeats."""
    # As a generator's result: filters on a plain column would be moved below it and normalise each text twice.
    safe = docs.select("doc_id", F.explode_outer(F.array(nfkc(F.col(text)))).alias("text")).where(
        ~is_blank(F.col("text")) & ~is_unsafe(F.col("text"))
    )
    split = safe.select("doc_id", sentences(collapse(mask_pii(F.col("text")))).alias("sentences"))
    unique = exact_sentences(split, min_len=min_len, per_document=per_document)
    if not near:
        return unique
    # Sentences of the whole corpus come from a shuffle, which is there to be read again.
    numbered = with_dense_id(unique, ["doc_id", "pos"], "id", costly=per_document)
    long = numbered.where(F.length("sentence") >= min_len)
    scope = ("doc_id",) if per_document else ()
    gone = near_duplicates(
        signatures(long, "sentence", perms).select("id", "signature", *scope), perms, threshold, scope
    )
    return numbered.join(gone, "id", "left_anti").select("doc_id", "pos", "sentence")


def clean(docs: DataFrame, text: str = "text", near: bool = True, min_chars: int = 5, **options) -> DataFrame:
    """Documents `(doc_id, text)` after the whole guard; those left with `min_chars` or less are dropped."""
    kept = clean_sentences(docs, text, near, **options)
    return (
        kept.groupBy("doc_id")
        .agg(F.expr("listagg(sentence, ' ') WITHIN GROUP (ORDER BY pos)").alias("text"))
        .where(F.length("text") > min_chars)
    )
