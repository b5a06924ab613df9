"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusengine.llm import exact_dedup, hard_negatives, hilbert_ann, lattice_score, license_spans, line_dedup, line_quality, mixing, order_minhash, phrases, piece_codec, token_counts, unit_dedup
from corpusengine.llm.common import ROW
from corpusengine.plans.inputs import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_hilbert_ann(spark, sf):
    return hilbert_ann.nearest(table(spark, sf, "embeddings"), F.col("id") % 100 == 0)


@query
def op2_lattice_score(spark, sf):
    return lattice_score.document_scores(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op3_unit_dedup(spark, sf):
    return unit_dedup.repeated_spans(table(spark, sf, "documents")).drop(ROW)


@query
def op4_license_spans(spark, sf):
    return license_spans.license_spans(table(spark, sf, "documents"))


@query
def op5_line_quality(spark, sf):
    return line_quality.report(table(spark, sf, "documents"))


ORACLES["op5_line_quality"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
             string_split(text, chr(10)) AS all_lines FROM d),
placed AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
grams AS (SELECT doc_id, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c, list(i) AS pos FROM placed GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, unnest(pos) AS i FROM grams)),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM covered GROUP BY doc_id),
judged AS (SELECT doc_id, text, len(ws) AS n_words, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  list_filter(all_lines, lambda x: trim(x, {SPACES}) = '' OR (
    length(regexp_replace(trim(x, {SPACES}), '[^#*$%&|<>!]', '', 'g')) * 10
      <= length(trim(x, {SPACES}))
    AND regexp_matches(x, '{line_quality.ENDS}')
    AND length(regexp_replace(x, '[^|›»•]', '', 'g')) < {line_quality.MENU}
    AND NOT regexp_matches(translate(trim(x, {SPACES}), {LOWER}), '{line_quality.NAVIGATION}')
    AND NOT regexp_matches(translate(x, {LOWER}), '{line_quality.BOILERPLATE}'))) AS good
  FROM w),
counted AS (SELECT j.doc_id, n_words::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(array_to_string(good, ''), '[\x20\x09-\x0D]', '', 'g')) AS left_chars
  FROM judged j LEFT JOIN repeats r ON r.doc_id = j.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {line_quality.MIN_WORDS} OR 100 * n_repeat_words > {line_quality.MAX_REPEATED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {line_quality.MIN_WORDS} OR 100 * n_repeat_words > {line_quality.MAX_REPEATED_PERCENT} * n_words)
    AND 100 * left_chars >= {100 - line_quality.MAX_LOSS_PERCENT} * word_chars AS kept
FROM counted"""


@query
def op6_line_dedup(spark, sf):
    return line_dedup.report(table(spark, sf, "documents"))


ORACLES["op6_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, line, pos, translate(trim(line, {SPACES}),
    {LOWER}) AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
frequent AS (SELECT key FROM lines WHERE length(key) >= {line_dedup.MIN_CHARS} GROUP BY key
  HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCUMENTS}),
marked AS (SELECT l.*, f.key IS NOT NULL AS gone FROM lines l LEFT JOIN frequent f ON f.key = l.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query
def op7_token_counts(spark, sf):
    return token_counts.token_counts(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_sentencepiece(spark, sf):
    return piece_codec.report(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op9_order_minhash(spark, sf):
    return order_minhash.classes(table(spark, sf, "documents")).drop(ROW)


@query
def op10_temperature_mix(spark, sf):
    return mixing.drawn(table(spark, sf, "documents")).drop(ROW)


@query
def op11_lemp_negatives(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


ORACLES["op11_lemp_negatives"] = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({hard_negatives.SCALE} * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {hard_negatives.POSITIVES})
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND {hard_negatives.LEAST_PERCENT} * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= {hard_negatives.NEGATIVES}"""


@query
def op12_exact_dedup(spark, sf):
    return exact_dedup.report(table(spark, sf, "documents"))


ORACLES["op12_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {LOWER}) AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d"""


@query
def op13_phrases(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"))


ORACLES["op13_phrases"] = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), {LOWER}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cut AS (
  SELECT lang, k AS size, phrase, n AS a, at_word, array_to_string(string_split(phrase, ' ')[:at_word], ' ') AS part,
    array_to_string(string_split(phrase, ' ')[at_word + 1:], ' ') AS rest
  FROM f, (SELECT unnest([1, 2]) AS at_word) WHERE k > 1 AND at_word < k AND n >= {phrases.LEAST}),
scored AS (
  SELECT c.*, p.n AS l, q.n AS r, ({phrases.SCALE}::HUGEINT * a * a) // (p.n::HUGEINT * q.n) AS score
  FROM cut c JOIN f p ON p.lang = c.lang AND p.phrase = c.part JOIN f q ON q.lang = c.lang AND q.phrase = c.rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, at_word) = 1),
holders AS (
  SELECT lang, part AS phrase, a FROM cut WHERE size = 3 AND at_word = 2
  UNION ALL SELECT lang, rest, a FROM cut WHERE size = 3 AND at_word = 1),
held AS (SELECT lang, phrase, max(a) AS longer FROM holders GROUP BY ALL),
kept AS (
  SELECT o.* FROM lowest o LEFT JOIN held h ON h.lang = o.lang AND h.phrase = o.phrase
  WHERE h.longer IS NULL OR 100 * h.longer < {phrases.OVERLAP_PERCENT} * o.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n AS n, score::BIGINT AS score
FROM kept k JOIN total t ON t.lang = k.lang QUALIFY rank <= {phrases.TOP}"""
