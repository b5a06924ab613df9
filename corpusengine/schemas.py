"""Table contracts as DDL, which readers and `createDataFrame` accept."""

SPANS = "doc_id BIGINT, pos INT, page_id INT, text STRING, size DOUBLE"

TOPIC = (
    "doc_id BIGINT, section_id STRING, section_name STRING, topic_id STRING, topic_name STRING, "
    "text STRING, keywords ARRAY<STRING>"
)

KEYWORD_ANSWERS = "batch_no BIGINT, topic_id STRING, keywords ARRAY<STRING>"

CHUNK = (
    "id BIGINT NOT NULL, chunk_text STRING NOT NULL, embedding ARRAY<FLOAT>, "
    "confidence_score DOUBLE NOT NULL, "
    "chunk_metadata STRUCT<section_id: STRING, section_name: STRING, topic_id: STRING, "
    "topic_name: STRING, text: STRING, keywords: ARRAY<STRING>, index_in_para: INT>, "
    "prev_chunk_id BIGINT, next_chunk_id BIGINT, created_at TIMESTAMP_NTZ, "
    "context_chunks ARRAY<STRUCT<chunk_id: BIGINT, chunk_text: STRING>>"
)

CONVERSATION = "id STRING, user_id INT, created_at TIMESTAMP_NTZ"

TURN = (
    "trace_id STRING, conversation_id STRING, user_id INT, sequence_id INT, query STRING, "
    "answer STRING, retrieved_chunks STRING, memory STRING, logs ARRAY<STRING>, "
    "created_at TIMESTAMP_NTZ"
)

HITS = "query_id BIGINT, chunk_id BIGINT, retrieval_source STRING, score DOUBLE, rank INT"
