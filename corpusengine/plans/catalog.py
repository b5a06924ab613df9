"""The registered queries: every operator over whole test tables.

Arrays leave as joined strings and computed columns are aliased, so that results compare
by value with the SQL in `catalog_sql`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusengine.functions import text as t
from corpusengine.functions.arrays import explode_rows
from corpusengine.operators import ann, chunking, dedup, hybrid, inference, knn, lexical, memory, postings, prompts, structure, trace
from corpusengine.operators.sequences import with_dense_id, with_sequence
from corpusengine.plans.inputs import (
    LENIENT_SIZES,
    STRICT_SIZES,
    document_chunks,
    documents,
    embedded_chunks,
    labelled_vectors,
    line_chunks,
    numbered_turns,
    routed_queries,
    section_centroids,
    stage_events,
    table,
    vector_queries,
)
from corpusengine.session import materialize, shared_dir, spread
from corpusengine.sources import chunks as chunk_table
from corpusengine.sources import corpus, delta_index, index, topics, turns, versions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(c: str | Column) -> Column:
    return F.array_join(c, "|")


def joined_ints(c: str) -> Column:
    return F.array_join(F.col(c).cast("array<string>"), "|")


# --- scans and sinks -------------------------------------------------------------------------


@query
def corpus_scan(spark, sf):
    return corpus.corpus(spark, f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")


@query
def page_text(spark, sf):
    return corpus.page_text(table(spark, sf, "pages")).select("page_id", "url", "text")


def _spans(spark, sf, sizes):
    return corpus.pages_to_spans(spread(table(spark, sf, "pages")), sizes)


@query
def page_spans(spark, sf):
    return _spans(spark, sf, LENIENT_SIZES)


def _topics(spark, sf):
    return structure.hierarchy(_spans(spark, sf, LENIENT_SIZES))


@query
def topics_roundtrip(spark, sf):
    enriched = _topics(spark, sf).withColumn("keywords", t.fallback_keywords(F.col("text")))
    path = f"{shared_dir(spark)}/corpusengine/topics-{uuid.uuid4().hex}"
    topics.write_topics(enriched.drop("topic_seq"), path)
    return topics.read_topics(spark, path).withColumn("keywords", joined("keywords"))


@query
def export_summary(spark, sf):
    return topics.export_summary(_topics(spark, sf), corpus.page_text(table(spark, sf, "pages")))


@query
def incremental_scan(spark, sf):
    synced = chunk_table.last_id(table(spark, sf, "embeddings"), "vec_id")
    return chunk_table.chunks_after(table(spark, sf, "documents"), synced, "doc_id").select("doc_id", "source", "text")


@query
def chunk_sample(spark, sf):
    return chunk_table.sample(table(spark, sf, "embeddings"), 2, "vec_id").select(
        "vec_id", F.col("label").cast("bigint").alias("label"), F.col("embedding_len").cast("bigint").alias("embedding_len")
    )


@query
def chunk_upsert(spark, sf):
    docs = table(spark, sf, "documents")
    target = docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("created_at"))
    labels = table(spark, sf, "labels")
    text = F.concat(F.lit("quality "), F.col("quality").cast("string"))
    changed = labels.select(F.col("doc_id").alias("id"), text.alias("text"))
    added = labels.select((-F.col("doc_id") - 1).alias("id"), text.alias("text"))
    source = changed.unionByName(added).withColumn("created_at", F.lit("now"))
    return chunk_table.upsert(target, source)


@query
def upsert_versions(spark, sf):
    """Documents as a versioned table; two increments, the second of rows with labels; then the last version."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("created_at"))
    folder = f"{shared_dir(spark)}/corpusengine/versions-{uuid.uuid4().hex}"
    versions.create(docs.where("id % 3 <> 0"), folder, "id", width=1000)
    late = docs.where("id % 3 = 0").withColumn("created_at", F.lit("late"))
    versions.upsert(spark, folder, late, batch="late documents", keep=("created_at",))
    labels = table(spark, sf, "labels").where("quality = 1")
    text = F.concat(F.lit("toxic "), F.col("toxic").cast("string"))
    changed = labels.select(F.col("doc_id").alias("id"), text.alias("text"))
    added = labels.select((-F.col("doc_id") - 1).alias("id"), text.alias("text"))
    source = changed.unionByName(added).withColumn("created_at", F.lit("now"))
    for _ in range(2):  # the second one is a replay and changes nothing
        versions.upsert(spark, folder, source, batch="labels", keep=("created_at",))
    return versions.read(spark, folder)


@query
def turn_append(spark, sf):
    pairs = turns.interactions(table(spark, sf, "conversations"))
    return turns.with_error_answer(pairs).select("conversation_id", "turn", "query", "answer")


# --- projections and filters -----------------------------------------------------------------


@query
def normalize_text(spark, sf):
    return t.normalize_batch(documents(spark, sf).select("doc_id", "text"), "text")


@query
def normalize_section(spark, sf):
    name = F.concat(F.lit("  Section: "), "source", F.lit(" ("), F.upper("lang"), F.lit(")! "), "text")
    return table(spark, sf, "documents").select("doc_id", t.normalize_section(name).alias("section"))


@query
def nfkc_text(spark, sf):
    """Texts with full-width digits and a ligature, which NFKC turns back."""
    wide = "".join(chr(0xFF10 + n) for n in range(10))
    compat = F.replace(F.translate("text", "0123456789", wide), F.lit("fi"), F.lit("\ufb01"))
    return table(spark, sf, "documents").select("doc_id", t.nfkc(compat).alias("text"))


@query
def truncate_fields(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        t.head(c, 500).alias("keyword_text"),
        t.head(c, 600).alias("keyword_text_long"),
        t.head(c, 2000).alias("topic_text"),
        t.head(c, 4000).alias("retrieved"),
        t.tail(c, 1000).alias("memory"),
    )


@query
def enriched_query(spark, sf):
    history = numbered_turns(spark, sf)
    both = memory.short_term(history).join(memory.long_term(history), "conversation_id")
    latest = history.groupBy("conversation_id").agg(F.max_by("query", "sequence_id").alias("query"))
    return both.join(latest, "conversation_id").select(
        "conversation_id",
        prompts.enriched_query(F.col("ltm"), F.col("stm"), t.normalize(F.col("query"))).alias("enriched"),
    )


@query
def safety_filter(spark, sf):
    return documents(spark, sf).where(~t.is_unsafe(F.col("text"))).select("doc_id", "text")


@query
def valid_queries(spark, sf):
    return table(spark, sf, "conversations").where(t.is_valid_query(F.col("text"))).select("conv_id", "turn", "text")


@query
def trace_lookup(spark, sf):
    return turns.lookup(table(spark, sf, "events"), "user_id", 7).select("event_id", "user_id", "event_type", "value")


@query
def pii_mask(spark, sf):
    return documents(spark, sf).select("doc_id", t.mask_pii(F.col("text")).alias("text"))


@query
def pii_mask_in(spark, sf):
    return documents(spark, sf).select("doc_id", t.mask_pii(F.col("text"), t.PII_INDIA).alias("text"))


@query
def pii_counts(spark, sf):
    counted = documents(spark, sf).select("lang", t.pii_counts(F.col("text")).alias("c")).select("lang", "c.*")
    return counted.groupBy("lang").agg(*[F.sum(c).alias(f"n_{c}") for c in ("email", "phone", "adhaar", "pan")])


# --- joins and aggregations ------------------------------------------------------------------


def _hybrid_inputs(spark, sf):
    chunks = embedded_chunks(spark, sf)
    return routed_queries(spark, sf, chunks), chunks


@query
def section_pool(spark, sf):
    queries, chunks = _hybrid_inputs(spark, sf)
    return hybrid.section_pool(queries, chunks)


def _answers(spark, sf):
    """Keyword answers for the labelled documents; toxic ones get too short a list."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    short = F.array("lang", "source")
    full = F.array("source", "lang", F.concat(F.lit("q"), F.col("quality").cast("string")), "source", "lang", "lang")
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        "doc_id", F.lit(1).alias("batch_no"), F.when(F.col("toxic") == 1, short).otherwise(full).alias("keywords")
    )


def _enriched(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    return inference.enrich(docs, _answers(spark, sf), ["doc_id"])


@query
def keyword_enrich(spark, sf):
    return _enriched(spark, sf).select("doc_id", joined("keywords").alias("keywords"), "keyword_source")


@query
def enrich_summary(spark, sf):
    return inference.enrich_summary(_enriched(spark, sf))


@query
def keyword_merge(spark, sf):
    answers = table(spark, sf, "documents").select(
        F.col("source").alias("topic_id"),
        F.col("doc_id").alias("batch_no"),
        F.array("lang", F.col("n_chars").cast("string")).alias("keywords"),
    )
    return inference.merge_answers(answers, ["topic_id"]).select("topic_id", joined("answered").alias("keywords"))


@query
def owned_turns(spark, sf):
    messages = table(spark, sf, "conversations")
    owners = messages.groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("user_id"))
    requests = messages.groupBy(F.col("conv_id").alias("conversation_id")).agg(F.lit(3).alias("user_id"))
    status = memory.access_status(requests, owners)
    mine = memory.owned(messages.withColumnRenamed("conv_id", "conversation_id"), owners, 3)
    return mine.join(status.select("conversation_id", "status"), "conversation_id").select(
        "conversation_id", "turn", "role", F.col("status").cast("bigint").alias("status")
    )


@query
def size_histogram(spark, sf):
    return structure.size_histogram(_spans(spark, sf, LENIENT_SIZES)).withColumn("sizes", joined_ints("sizes"))


def _named_chunks(spark, sf):
    return table(spark, sf, "documents").select(
        F.concat(F.lit(" "), F.initcap("source"), F.lit(" ("), "lang", F.lit(") ")).alias("section_name")
    )


@query
def distinct_sections(spark, sf):
    return _named_chunks(spark, sf).select(t.strip(F.col("section_name")).alias("section")).distinct()


@query
def normalized_sections(spark, sf):
    return (
        _named_chunks(spark, sf)
        .select(t.normalize_section(F.col("section_name")).alias("section"))
        .distinct()
        .orderBy("section")
    )


@query
def next_sequence(spark, sf):
    return memory.next_sequence(turns.interactions(table(spark, sf, "conversations")))


@query
def fallback_keywords(spark, sf):
    return documents(spark, sf).select("doc_id", joined(t.fallback_keywords(F.col("text"))).alias("keywords"))


@query
def index_stats(spark, sf):
    vectors = labelled_vectors(spark, sf)
    whole = index.stats(vectors).select(F.lit("all").alias("section"), "*")
    return whole.unionByName(index.stats(vectors, "section"))


@query
def batch_requests(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return inference.batches(docs, 5, ["doc_id"]).groupBy("batch_no").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.sum("n_chars").alias("n_chars")
    )


@query
def trace_rollup(spark, sf):
    return trace.rollup(stage_events(spark, sf)).withColumn("lines", joined("lines"))


@query
def turn_rows(spark, sf):
    """Complete turns appended in three batches, one of them twice; the first turn of a conversation has a trace."""
    pairs = numbered_turns(spark, sf).withColumn("user_id", F.col("conversation_id") % 7)
    first = F.col("sequence_id") == 1
    traced = pairs.withColumn(
        "trace_id", F.when(first, F.col("conversation_id").cast("string")).otherwise(F.concat_ws("-", "conversation_id", "sequence_id"))
    )
    rollups = trace.rollup(stage_events(spark, sf), part_lines=20)
    whole = materialize(turns.complete_rows(traced, rollups, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")), "turn-rows")
    path = f"{shared_dir(spark)}/corpusengine/turns-{uuid.uuid4().hex}"
    for batch in (0, 1, 2, 1):
        turns.append_batch(whole.where(F.col("user_id") % 3 == batch), path, batch)
    return turns.read_turns(spark, path).select(
        "trace_id", "conversation_id", F.col("user_id").cast("bigint").alias("user_id"), F.col("sequence_id").cast("bigint").alias("sequence_id"),
        "query", "answer", "memory", F.md5(joined("logs").cast("binary")).alias("logs_md5"), F.size("logs").cast("bigint").alias("n_logs"),
        F.col("created_at").cast("string").alias("created_at"),
    )


@query
def stage_latency(spark, sf):
    r = trace.stage_latency(stage_events(spark, sf))
    return r.select(
        "stage", "n", F.round("mean_seconds", 6).alias("mean_seconds"), "max_seconds",
        F.round("q_seconds", 6).alias("p95_seconds"), "n_failed",
    )


# --- ordered sequences -----------------------------------------------------------------------


@query
def hierarchy_topics(spark, sf):
    return _topics(spark, sf).drop("topic_seq")


def _strict_topics(spark, sf):
    return structure.hierarchy(
        _spans(spark, sf, STRICT_SIZES), orphan_policy="drop", implicit_header=False, max_header_len=None, min_sizes=2
    )


@query
def hierarchy_strict(spark, sf):
    return _strict_topics(spark, sf).drop("topic_seq")


@query
def paragraph_numbers(spark, sf):
    survivors = _strict_topics(spark, sf).where("text <> ''")
    return structure.paragraph_numbers(survivors).select("doc_id", "topic_id", "paragraph_id")


@query
def chunk_ids(spark, sf):
    return line_chunks(spark, sf).select(
        "id", "doc_id", F.col("index_in_para").cast("bigint").alias("index_in_para"), "chunk_text"
    )


@query
def chunk_links(spark, sf):
    return chunking.link(line_chunks(spark, sf).drop("keywords"), ["doc_id", "section"]).select(
        "id", "prev_chunk_id", "next_chunk_id"
    )


@query
def chunk_confidence(spark, sf):
    return chunking.score(line_chunks(spark, sf)).select("id", "confidence_score")


def _contexts(spark, sf):
    return chunking.context(chunking.score(line_chunks(spark, sf)), ["doc_id", "section"])


@query
def context_window(spark, sf):
    ids = F.transform("context_chunks", lambda c: c["chunk_id"].cast("string"))
    texts = F.transform("context_chunks", lambda c: c["chunk_text"])
    return _contexts(spark, sf).select("id", joined(ids).alias("context_ids"), F.md5(F.array_join(texts, "\n")).alias("text_md5"))


@query
def unique_texts(spark, sf):
    hits = _contexts(spark, sf).select(
        F.col("doc_id").alias("query_id"), F.col("index_in_para").alias("position"), "chunk_text", "context_chunks"
    )
    return hybrid.unique_texts(hits).select("query_id", F.col("text_no").cast("bigint").alias("text_no"), "text")


@query
def short_term_memory(spark, sf):
    return memory.short_term(numbered_turns(spark, sf))


@query
def long_term_memory(spark, sf):
    return memory.long_term(numbered_turns(spark, sf))


@query
def memory_tail(spark, sf):
    return memory.memory_tail(numbered_turns(spark, sf))


# --- deduplication ---------------------------------------------------------------------------


def _sentences(spark, sf):
    return documents(spark, sf).select("doc_id", t.sentences(t.collapse(F.col("text"))).alias("sentences"))


@query
def exact_dedup(spark, sf):
    return dedup.exact_sentences(_sentences(spark, sf))


def _numbered_sentences(spark, sf):
    unique = dedup.exact_sentences(_sentences(spark, sf)).where(F.length("sentence") >= dedup.MIN_LEN)
    return with_dense_id(unique, ["doc_id", "pos"])


@query
def minhash_signature(spark, sf):
    # Short sentences keep their repeats. Side by side their signatures are worked out once for a batch, and the
    # table that they are written to holds each of them little more than once for a part.
    unique = dedup.exact_sentences(_sentences(spark, sf)).sortWithinPartitions("sentence")
    signed = dedup.signatures(unique, "sentence")
    return signed.select("doc_id", "pos", joined_ints("signature").alias("signature"))


@query
def near_dup_pairs(spark, sf):
    rows = _numbered_sentences(spark, sf)
    return dedup.near_duplicates(dedup.signatures(rows, "sentence").select("id", "signature"))


@query
def near_dedup(spark, sf):
    return dedup.clean_sentences(documents(spark, sf))


@query
def clean_documents(spark, sf):
    return dedup.clean(documents(spark, sf), near=False)


# --- chunks ----------------------------------------------------------------------------------


def _recursive(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    return chunking.recursive(docs)


@query
def recursive_chunks(spark, sf):
    return _recursive(spark, sf)


@query
def chunk_invariants(spark, sf):
    """Chunk limits and coverage per document: what the text loses or gains is only white space and overlap."""
    bare = F.regexp_replace("chunk_text", f"{t.WS}+", "")
    pieces = _recursive(spark, sf).withColumn("_bare", bare)
    per_doc = pieces.groupBy("doc_id").agg(
        F.count_if(F.length("chunk_text") > 800).alias("n_oversize"),
        F.count_if(F.col("chunk_text") != t.strip(F.col("chunk_text"))).alias("n_unstripped"),
        F.max("index_in_para").alias("_n"),
        F.count("*").alias("_rows"),
        F.sum(F.length("_bare")).alias("_chars"),
        F.min_by("_bare", "index_in_para").alias("_first"),
        F.max_by("_bare", "index_in_para").alias("_last"),
    )
    docs = documents(spark, sf).select("doc_id", F.regexp_replace("text", f"{t.WS}+", "").alias("_all"))
    return docs.join(per_doc, "doc_id").select(
        "doc_id",
        "n_oversize",
        "n_unstripped",
        (F.col("_n") == F.col("_rows")).alias("numbered"),
        F.startswith("_all", "_first").alias("starts_right"),
        F.endswith("_all", "_last").alias("ends_right"),
        F.col("_chars").between(F.length("_all"), F.length("_all") + 150 * (F.col("_n") - 1)).alias("covers"),
    )


# --- retrieval -------------------------------------------------------------------------------


def _hits(df):
    return df.select("query_id", "vec_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query
def knn_l2(spark, sf):
    return _hits(knn.knn(vector_queries(spark, sf), labelled_vectors(spark, sf)))


@query
def knn_cosine(spark, sf):
    return _hits(knn.knn(vector_queries(spark, sf), labelled_vectors(spark, sf), metric="cosine"))


@query
def vector_normalize(spark, sf):
    doubled = table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1)).alias("embedding")
    )
    return knn.normalize_vectors(doubled).select("vec_id", F.posexplode("embedding").alias("pos", "x")).select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), (F.round("x", 6) + 0.0).alias("x")
    )


@query
def knn_by_section(spark, sf):
    return _hits(knn.knn_by_section(vector_queries(spark, sf), labelled_vectors(spark, sf)))


@query
def knn_by_section_legacy(spark, sf):
    return _hits(knn.knn_by_section(vector_queries(spark, sf), labelled_vectors(spark, sf), legacy_order=True))


@query
def knn_sections_default(spark, sf):
    """Cosine search in named sections; labels above 6 are unknown and lie under `default`."""
    vectors = table(spark, sf, "embeddings")
    spelt = lambda n: F.concat(F.lit("  LABEL "), n.cast("string"), F.lit("! "))
    known = vectors.where("label <= 6").select(spelt(F.col("label")).alias("section"))
    index = knn.section_index(vectors.select("vec_id", "embedding", spelt(F.col("label")).alias("section")), known)
    following = F.when(F.col("label") % 2 != 0, spelt((F.col("label") + 1) % 10))
    queries = vectors.select(
        F.col("vec_id").alias("query_id"), "embedding", F.array(spelt(F.col("label")), following).alias("sections")
    )
    return _hits(knn.knn_in_named_sections(queries, index))


@query
def flat_search(spark, sf):
    return knn.flat_search(vector_queries(spark, sf), labelled_vectors(spark, sf)).select("query_id", "vec_id", "score")


@query
def hybrid_merge(spark, sf):
    queries, vectors = vector_queries(spark, sf), labelled_vectors(spark, sf)
    near = knn.knn(queries, vectors).withColumnRenamed("vec_id", "chunk_id")
    inside = knn.knn_by_section(queries, vectors).withColumnRenamed("vec_id", "chunk_id")
    return hybrid.merge(near, inside).select(
        "query_id", F.col("position").cast("bigint").alias("position"), "chunk_id", "retrieval_source"
    )


@query
def section_pref(spark, sf):
    vectors = labelled_vectors(spark, sf)
    hits = knn.knn(vector_queries(spark, sf), vectors).join(vectors.select("vec_id", "section"), "vec_id")
    proposed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "section"))).alias("p"))
    names = F.transform("p", lambda x: x["section"])
    return proposed.select("query_id", joined(hybrid.section_preference(names)).alias("sections"))


@query
def bm25_search(spark, sf):
    queries, chunks = _hybrid_inputs(spark, sf)
    return lexical.bm25(queries, chunks).withColumn("rank", F.col("rank").cast("bigint"))


@query
def bm25_postings(spark, sf):
    """The same search over stored inverted lists, which skips blocks that cannot reach the k-th score."""
    # The vectors are used up by the routing and the texts are in their table: neither is written.
    queries = routed_queries(spark, sf, inference.embed(document_chunks(spark, sf), "text").drop("error"))
    chunks = document_chunks(spark, sf, even=False)
    folder = f"{shared_dir(spark)}/corpusengine/postings-{uuid.uuid4().hex}"
    postings.save(chunks, folder)
    lists, stats = postings.load(spark, folder)
    return postings.bm25(queries, lists, stats).withColumn("rank", F.col("rank").cast("bigint"))


@query
def hybrid_search(spark, sf):
    queries, chunks = _hybrid_inputs(spark, sf)
    return hybrid.search(queries, chunks).withColumn("position", F.col("position").cast("bigint"))


@query
def rerank_overlap(spark, sf):
    queries, chunks = _hybrid_inputs(spark, sf)
    hits = lexical.bm25(queries, chunks).select("query_id", "chunk_id")
    pairs = hits.join(queries.select("query_id", "query"), "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    return hybrid.rerank(pairs, 3).select("query_id", "chunk_id", "rerank_score", F.col("rank").cast("bigint").alias("rank"))


@query
def ivf_search(spark, sf):
    vectors = labelled_vectors(spark, sf)
    centres = ann.ivf_train(vectors, 16)
    cells = ann.ivf_assign(vectors, centres)
    return _hits(ann.ivf_search(vector_queries(spark, sf), cells, centres, nprobe=11))


@query
def ivf_exact(spark, sf):
    vectors = labelled_vectors(spark, sf)
    centres = ann.ivf_train(vectors, 16)
    index = materialize(ann.ivf_index(vectors, centres), "ivf-index")
    return _hits(ann.ivf_exact_search(vector_queries(spark, sf), index, ann.ivf_cells(index, centres)))


@query
def ann_lsh(spark, sf):
    """One table: the query's own code and all that differ from it in one bit."""
    index = materialize(ann.lsh_index(labelled_vectors(spark, sf), 64, tables=1, bits=4), "lsh-index")
    return _hits(ann.lsh_tables_search(vector_queries(spark, sf), index, 64, tables=1, bits=4, probes=4))


@query
def ann_lsh_tables(spark, sf):
    index = materialize(ann.lsh_index(labelled_vectors(spark, sf), 64, tables=8, bits=4), "lsh-index")
    return _hits(ann.lsh_tables_search(vector_queries(spark, sf), index, 64, tables=8, bits=4, probes=2))


@query
def index_updates(spark, sf):
    """Vectors by cell with three batches of updates and deletions, a compaction between them, and a replay."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("bigint").alias("cell"))
    folder = f"{shared_dir(spark)}/corpusengine/delta-index-{uuid.uuid4().hex}"
    delta_index.create(vectors.where("vec_id % 5 <> 0"), folder, key="vec_id")
    moved = vectors.where("vec_id % 10 = 1").withColumn("cell", F.col("cell") + 1)
    delta_index.apply(spark, folder, 0, vectors.where("vec_id % 5 = 0").unionByName(moved))
    delta_index.apply(spark, folder, 1, deletes=vectors.where("vec_id % 7 = 0"))
    delta_index.compact(spark, folder)
    again = vectors.where("vec_id % 14 = 0").withColumn("cell", F.lit(0).cast("bigint"))
    for batch in (1, 2, 2):  # batch 1 is merged already, batch 2 is sent twice
        delta_index.apply(spark, folder, batch, again, vectors.where("vec_id % 11 = 3"))
    index_now = delta_index.read(spark, folder)
    return index_now.select("vec_id", "cell", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


def _label_routes(spark, sf, **options):
    queries = vector_queries(spark, sf).drop("sections")
    routed = hybrid.route(queries, section_centroids(labelled_vectors(spark, sf)), **options)
    return routed.select("query_id", joined("candidates").alias("candidates"), joined("sections").alias("sections"))


@query
def route_queries(spark, sf):
    return _label_routes(spark, sf)


@query
def route_threshold(spark, sf):
    return _label_routes(spark, sf, k=2, threshold=0.55)


@query
def route_named(spark, sf):
    """Documents as queries, with names for their section as a model might give them: none, exact, similar or unknown."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("query_id"), "source", "lang")
    own = F.concat_ws(" ", "source", "lang")
    case = F.col("doc_id") % 4
    names = (
        F.when(case == 1, F.array(F.concat(F.upper("source"), F.lit("  ("), "lang", F.lit(")!"))))
        .when(case == 2, F.array(F.concat(F.lit("the "), "source", F.lit(" pages")), F.concat_ws(" ", "lang", "lang")))
        .when(case == 3, F.array(F.lit("nothing like it"), own, F.concat_ws(" ", "lang", "source")))
    )
    queries = docs.select("query_id", F.concat_ws(" ", "lang", F.lit("of"), "source").alias("query"))
    routed = hybrid.route_named(queries, docs.select("query_id", names.alias("names")), docs.select(own.alias("section")))
    return routed.select("query_id", joined("sections").alias("sections"))


def _closeness():
    """A pair model for the check: how close two lengths are; it fails on texts whose length is a multiple of eleven."""

    def score(queries, texts):
        if any(len(t) % 11 == 0 for t in texts):
            raise ValueError("no score")
        return [-abs(len(q) - len(t)) / (len(q) + len(t) + 1) for q, t in zip(queries, texts, strict=True)]

    return score


@query
def rerank_model(spark, sf):
    """Every conversation's messages, ranked by a pair model against its first message."""
    messages = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), "text")
    firsts = messages.groupBy("query_id").agg(F.min_by("text", "position").alias("query"))
    best = hybrid.rerank_model(messages.join(firsts, "query_id"), _closeness, 5)
    return best.select("query_id", "position", (F.col("rerank_score") + 0.0).alias("rerank_score"), F.col("rank").cast("bigint").alias("rank"), "scored")


# --- model application -----------------------------------------------------------------------


@query
def embed_hashing(spark, sf):
    embedded = inference.embed(document_chunks(spark, sf), "text")
    vectors = explode_rows(embedded, ["chunk_id"], F.col("embedding"), "pos", "x")
    return vectors.select("chunk_id", F.col("pos").cast("bigint").alias("pos"), F.round(F.col("x").cast("double"), 6).alias("x"))


@query
def keyword_requests(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("topic_id"), "text")
    return inference.keyword_requests(docs, 3, ("doc_id",))


def _moody_model():
    """A keyword model for the check: it fails on some payloads for good and answers others only when asked again."""
    asked: dict[str, int] = {}

    def answer(payloads):
        out = []
        for payload in payloads:
            topics = [t["topic_id"] for t in json.loads(payload)]
            numbers = [int(t[1:]) for t in topics]
            asked[payload] = asked.get(payload, 0) + 1
            if any(n % 35 == 0 for n in numbers):
                raise RuntimeError("model down")
            if any(n % 7 == 0 for n in numbers) and asked[payload] == 1:
                out.append("" if numbers[0] % 2 else "Sorry, no.")
            else:
                out.append("```json\n" + json.dumps({t: [f"{t} a", f"{t} b", "c"] for t in topics}) + "\n```")
        return out

    return answer


@query
def keyword_answers(spark, sf):
    """Keywords of every document from a model that often fails, and how often it had to be asked."""
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("topic_id"), "text")
    requests = inference.keyword_requests(docs, 3, ("doc_id",))
    asked = inference.apply_accepted(
        requests, "payload", _moody_model(), inference.refuse_no_json_map, "raw", batch_size=1, backoff=0.0, give_up=1_000_000
    )
    asked = materialize(asked, "keyword-raw")
    answers = asked.where("raw IS NOT NULL").select(
        "batch_no", F.explode(t.parse_json_map(F.col("raw"))).alias("topic_id", "keywords")
    )
    enriched = inference.enrich(docs, answers, ["topic_id"])
    tries = asked.select(
        "attempts", F.explode(F.from_json("payload", "array<struct<topic_id: string>>")).alias("t")
    ).select(F.col("t.topic_id").alias("topic_id"), F.col("attempts").cast("bigint").alias("attempts"))
    return enriched.join(tries, "topic_id").select("doc_id", joined("keywords").alias("keywords"), "keyword_source", "attempts")


@query
def parse_model_output(spark, sf):
    docs = documents(spark, sf)
    listed = F.concat(F.lit('Sure: ["'), "source", F.lit('", "'), "lang", F.lit('", "x"] done'))
    fenced = F.concat(F.lit("```json\n{\""), "source", F.lit('": ["'), "lang", F.lit('", "x"]}\n```'))
    default = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    return docs.select(
        "doc_id",
        joined(t.parse_lines(F.col("text"))).alias("lines"),
        joined(t.parse_list(listed, default)).alias("listed"),
        joined(t.parse_list(F.regexp_replace("text", r"[\[\]]", ""), default)).alias("unlisted"),
        joined(F.element_at(t.parse_json_map(fenced), F.col("source"))).alias("mapped"),
        F.size(t.parse_json_map(F.col("text"))).cast("bigint").alias("n_unmapped"),
    )


@query
def prompt_assembly(spark, sf):
    messages = table(spark, sf, "conversations")
    source = F.when(F.col("role") == "system", "context").otherwise(F.col("role"))
    hits = messages.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), source.alias("retrieval_source"), "text")
    parts = prompts.prompt_parts(hits)
    history = numbered_turns(spark, sf)
    queries = (
        history.groupBy("conversation_id").agg(F.max_by("query", "sequence_id").alias("query"))
        .join(memory.short_term(history), "conversation_id")
        .join(memory.long_term(history), "conversation_id")
        .withColumnRenamed("conversation_id", "query_id")
    )
    ranked = hits.select("query_id", (F.col("position") + 1).alias("rank"), F.col("retrieval_source").alias("section"), "text")
    return (
        prompts.answer_prompts(queries, parts)
        .join(prompts.context_blocks(ranked), "query_id")
        .join(prompts.doc_blocks(ranked), "query_id")
    )


def _message_queries(spark, sf):
    """Every user message as a query, with the two user messages after it, the limit of the guard, as candidates."""
    users = table(spark, sf, "conversations").where("role = 'user'")
    numbered = materialize(with_sequence(users, ["conv_id"], ["turn"], "n"), "user-messages")
    # A message goes to its own query and to those of the two before it.
    texts = numbered.select(
        "conv_id", F.posexplode(F.array(F.col("n"), F.col("n") - 1, F.col("n") - 2)).alias("no", "n"), "text"
    ).where("n > 0")
    asked = (
        texts.groupBy("conv_id", "n")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("no", "text"))), lambda x: x["text"]).alias("texts"))
        .select(F.concat_ws(":", "conv_id", "n").alias("query_id"), F.get("texts", F.lit(0)).alias("query"), F.slice("texts", 2, 2).alias("candidates"))
    )
    return materialize(asked, "expansion-queries")


@query
def expansion_guard(spark, sf):
    """Without the near-duplicate step."""
    return inference.guard_expansions(_message_queries(spark, sf), near=False).select("query_id", joined("expansions").alias("expansions"))


@query
def expansion_guard_turns(spark, sf):
    """The whole guard; near duplicates go too."""
    return inference.guard_expansions(_message_queries(spark, sf)).select("query_id", joined("expansions").alias("expansions"))
