"""DuckDB SQL that states independently what the registered queries compute."""

from __future__ import annotations

from corpusengine.functions.text import (
    DEFAULT_KEYWORDS,
    HARMFUL_WORDS,
    INJECTION_PHRASES,
    KEYWORD_STOPWORDS,
    PII_DEFAULT,
    PII_INDIA,
    WS,
    WS_INNER,
)
from corpusengine.plans.inputs import LENIENT_SIZES, STRICT_SIZES
from corpusengine.sources.corpus import BLOCK_TAGS, BODY_SIZE
from corpusengine.sources.turns import ERROR_ANSWER


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def normalize(x: str) -> str:
    return collapse(f"lower(coalesce({x}, ''))")


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def mask(x: str, patterns=PII_DEFAULT) -> str:
    for _, pattern, label in patterns:
        x = f"regexp_replace({x}, '{pattern}', '{label}', 'g')"
    return x


def section_name(x: str) -> str:
    bare = f"regexp_replace({strip(f'lower({x})')}, '[^\\p{{L}}\\p{{N}}_{WS_INNER}]', '', 'g')"
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN 'default' ELSE regexp_replace({bare}, '{WS}+', ' ', 'g') END"


def sentences(x: str) -> str:
    cut = f"regexp_replace({x}, '([.!?]) +', '\\1' || chr(1), 'g')"
    return f"list_filter(string_split({cut}, chr(1)), lambda s: s <> '')"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def unsafe(x: str) -> str:
    phrases = " OR ".join(f"contains(lower({x}), '{p}')" for p in INJECTION_PHRASES)
    return f"({phrases} OR list_has_any(string_split_regex(lower({x}), '{WS}+'), {_list(HARMFUL_WORDS)}))"


def spans(sizes: dict[str, float]) -> str:
    """CTE `spans(doc_id, pos, text, size)`: depth by running count, then the last tag opened at that depth."""
    tags = "|".join(sizes)
    blocks = "|".join(t for t in BLOCK_TAGS if t not in sizes)
    h = "regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g')"
    h = f"regexp_replace({h}, '(?i)</({tags})>', chr(1) || chr(2), 'g')"
    h = f"regexp_replace({h}, '(?i)<({tags})(\\s[^>]*)?>', chr(1) || '\\1' || chr(2), 'g')"
    h = f"regexp_replace({h}, '(?i)</?({blocks})(\\s[^>]*)?>', chr(1) || chr(3) || chr(2), 'g')"
    h = f"regexp_replace(regexp_replace({h}, '(?i)<br\\s*/?>', ' ', 'g'), '<[^>]*>', '', 'g')"
    cases = " ".join(f"WHEN '{tag}' THEN {size}" for tag, size in sizes.items())
    body = "string_split(part, chr(2))[-1]"
    return f"""
parts AS (SELECT page_id AS doc_id, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS pos
          FROM (SELECT page_id, string_split({h}, chr(1)) AS p FROM pages)),
marks AS (SELECT *, CASE WHEN contains(part, chr(2)) THEN lower(string_split(part, chr(2))[1]) ELSE chr(3) END AS mark FROM parts),
depths AS (SELECT *, CAST(CASE mark {cases} END AS DOUBLE) AS opened,
           sum(CASE mark WHEN chr(3) THEN 0 WHEN '' THEN -1 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS depth FROM marks),
spans AS (SELECT * FROM (
          SELECT doc_id, pos::BIGINT AS pos, {strip(decode(body))} AS text,
                 CASE WHEN depth = 0 THEN {BODY_SIZE} ELSE last_value(opened IGNORE NULLS) OVER (
                   PARTITION BY doc_id, depth ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS size FROM depths)
          WHERE text <> '')"""


def decode(x: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


HISTOGRAM = """
hist AS (SELECT doc_id, list_sort(list(DISTINCT size), 'DESC') AS sizes, count(*)::BIGINT AS n_spans FROM spans GROUP BY 1)"""

# Sequential reading of the spans: running counts, then the topic each line belongs to.
LENIENT_TOPICS = f"""
{spans(LENIENT_SIZES)}, {HISTOGRAM},
flags AS (SELECT s.*, size = sizes[1] AND length(text) < 100 AS is_sec,
                 NOT (size = sizes[1] AND length(text) < 100)
                   AND size = coalesce(sizes[2], sizes[1]) AND length(text) < 100 AS is_top
          FROM spans s JOIN hist USING (doc_id)),
runs AS (SELECT *, 1 + sum(is_sec::INT) OVER w AS sec_no, sum(is_top::INT) OVER w AS top_run FROM flags
         WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
named AS (SELECT *, last_value(CASE WHEN is_sec THEN text END IGNORE NULLS) OVER w AS sec_name,
                 sum(is_top::INT) OVER (PARTITION BY doc_id, sec_no ORDER BY pos) AS top_no FROM runs
          WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
lines AS (SELECT doc_id, top_run, string_agg(text, ' ' ORDER BY pos) AS text FROM runs
          WHERE NOT is_sec AND NOT is_top AND top_run > 0 GROUP BY 1, 2),
topics AS (SELECT n.doc_id, printf('S%03d', n.sec_no::INT) AS section_id, coalesce(n.sec_name, 'Header') AS section_name,
                  printf('S%03d_T%03d', n.sec_no::INT, n.top_no::INT) AS topic_id, n.text AS topic_name,
                  coalesce(l.text, '') AS text, n.top_run
           FROM named n LEFT JOIN lines l ON l.doc_id = n.doc_id AND l.top_run = n.top_run WHERE n.is_top)"""

STRICT_TOPICS = f"""
{spans(STRICT_SIZES)}, {HISTOGRAM},
flags AS (SELECT s.*, size = sizes[1] AS is_sec, size = sizes[2] AS is_top
          FROM spans s JOIN hist USING (doc_id) WHERE len(sizes) >= 2),
secs AS (SELECT *, sum(is_sec::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS sec_no FROM flags),
tops AS (SELECT *, sum(is_top::INT) OVER (PARTITION BY doc_id, sec_no ORDER BY pos) AS top_no,
                first_value(text) OVER (PARTITION BY doc_id, sec_no ORDER BY pos) AS sec_name
         FROM secs WHERE sec_no > 0),
topics AS (SELECT doc_id, printf('S%03d', sec_no::INT) AS section_id, any_value(sec_name) AS section_name,
                  printf('S%03d_T%03d', sec_no::INT, top_no::INT) AS topic_id,
                  max(CASE WHEN is_top THEN text END) AS topic_name,
                  coalesce(string_agg(CASE WHEN NOT is_top THEN text END, ' ' ORDER BY pos), '') AS text,
                  min(pos) AS first_pos
           FROM tops WHERE top_no > 0 GROUP BY doc_id, sec_no, top_no)"""


def keywords(source: str, name: str = "kw") -> str:
    """CTEs ending in `kw(doc_id, k)` for `source(doc_id, text)`."""
    return f"""
toks AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS pos
         FROM (SELECT doc_id, string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+') AS t FROM {source})),
freq AS (SELECT doc_id, w, count(*) AS c, min(pos) AS p FROM toks
         WHERE regexp_full_match(w, '[a-z]{{4,}}') AND NOT list_contains({_list(KEYWORD_STOPWORDS)}, w) GROUP BY 1, 2),
topw AS (SELECT doc_id, list(w ORDER BY c DESC, p) AS k
         FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, p) AS rn FROM freq) WHERE rn <= 5 GROUP BY 1),
{name} AS (SELECT s.doc_id, list_slice(list_concat(coalesce(t.k, []), {_list(DEFAULT_KEYWORDS)}), 1, 5) AS k
       FROM {source} s LEFT JOIN topw t USING (doc_id))"""


LINES = f"""
lines0 AS (SELECT doc_id, source AS section, {strip("unnest(string_split(text, chr(10)))")} AS chunk_text,
                  generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents),
lines AS (SELECT doc_id, section, chunk_text, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS index_in_para,
                 row_number() OVER (ORDER BY doc_id, ln) AS id FROM lines0 WHERE chunk_text <> '')"""

SCORED = f"""
{LINES}, {keywords("documents")},
scored AS (SELECT l.*, round(0.5 * CASE WHEN length(chunk_text) BETWEEN 80 AND 200 THEN 1.0 ELSE 0.6 END
                + 0.3 * len(list_filter(k, lambda x: contains(lower(chunk_text), lower(x)))) / len(k)
                + 0.2 * CASE WHEN regexp_matches(chunk_text, '[.!?]$') THEN 1.0 ELSE 0.7 END, 3) AS confidence_score
           FROM lines l JOIN kw USING (doc_id))"""

WINDOWS = f"""
{SCORED},
reach AS (SELECT *, CASE WHEN confidence_score >= 0.85 THEN 1 WHEN confidence_score >= 0.6 THEN 2 ELSE 3 END AS r FROM scored),
near AS (SELECT a.id, a.doc_id, a.index_in_para, a.chunk_text AS own, b.id AS cid, b.chunk_text AS ctext
         FROM reach a JOIN scored b ON a.doc_id = b.doc_id AND b.id BETWEEN a.id - a.r AND a.id + a.r)"""

TURNS = """
pairs AS (SELECT u.conv_id AS conversation_id, u.turn, u.text AS query, a.text AS answer
          FROM conversations u LEFT JOIN conversations a
            ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
turns AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS seq,
                 row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS back,
                 'User: ' || query || chr(10) || 'Assistant: ' || coalesce(answer, 'None') AS said FROM pairs),
stm AS (SELECT conversation_id, string_agg(said, chr(10) ORDER BY seq) AS stm FROM turns WHERE back <= 3 GROUP BY 1),
ltm AS (SELECT conversation_id, coalesce(answer, '') AS ltm, query FROM turns WHERE back = 1)"""

SENTENCES = f"""
sents AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos
          FROM (SELECT doc_id, {sentences(collapse("text"))} AS s FROM documents))"""

FIRST_SENTENCES = """
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY doc_id, pos) AS nth FROM sents)
           WHERE nth = 1 OR length(sentence) < 20)"""

SAFE_SENTENCES = f"""
safe AS (SELECT doc_id, {sentences(collapse(mask("nfc_normalize(text)")))} AS s FROM documents WHERE NOT {unsafe('text')} AND {strip('text')} <> ''),
sents AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM safe)"""

VECTORS = """
vecs AS (SELECT vec_id, embedding::DOUBLE[] AS v, label, 'label ' || label AS section FROM embeddings),
unit AS (SELECT *, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-9)) AS u FROM vecs)"""

# One row per (query, vector); queries are all vectors, asking for their own label and the next.
PAIRS = f"""
{VECTORS},
pairs AS (SELECT q.vec_id AS query_id, d.vec_id, d.section, q.label AS l0, (q.label + 1) % 10 AS l1, d.label,
                 round(greatest(list_inner_product(q.v, q.v) + list_inner_product(d.v, d.v)
                                - 2 * list_inner_product(q.v, d.v), 0), 6) + 0.0 AS d
          FROM vecs q, vecs d)"""

L2 = f"""
{PAIRS},
l2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM pairs) WHERE rank <= 5),
bysec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM pairs
                         WHERE label IN (l0, l1)) WHERE rank <= 5)"""


def lsh_tables(tables: int, bits: int, probes: int) -> str:
    """CTE `near_met(query_id, vec_id, d, rank)`: vectors that share a probed bucket with the query in any table."""
    return f"""{PAIRS},
planes AS (SELECT t, b, j, CASE WHEN md5(t || ':' || b || ':' || j)[1] < '8' THEN 1 ELSE -1 END AS s
           FROM (SELECT unnest(range({tables})) AS t), (SELECT unnest(range({bits})) AS b), (SELECT unnest(range(64)) AS j)),
components AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings),
dots AS MATERIALIZED (SELECT vec_id, t, b, sum(x * s) AS d FROM components JOIN planes USING (j) GROUP BY ALL),
codes AS MATERIALIZED (SELECT vec_id, t, sum(CASE WHEN d > 0 THEN 1 << b ELSE 0 END)::BIGINT AS code FROM dots GROUP BY ALL),
flips AS (SELECT vec_id, t, b FROM dots QUALIFY row_number() OVER (PARTITION BY vec_id, t ORDER BY abs(d), b) <= {probes}),
probes AS (SELECT vec_id, t, code FROM codes UNION ALL SELECT vec_id, t, xor(code, (1 << b)::BIGINT) FROM flips JOIN codes USING (vec_id, t)),
met AS (SELECT DISTINCT p.vec_id AS query_id, c.vec_id FROM probes p JOIN codes c USING (t, code)),
near_met AS (SELECT query_id, vec_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM met JOIN pairs USING (query_id, vec_id))"""


def embed(source: str, key: str, text: str, name: str) -> str:
    """CTE `name(key, cell, x)`: the non-zero cells of the hashed-word vector."""
    return f"""
{name}_w AS MATERIALIZED (SELECT {key}, unnest({words(f'lower({text})')}) AS w FROM {source}),
{name}_c AS (SELECT {key}, ('0x' || substr(md5(w), 1, 8))::UBIGINT % 64 AS cell, count(*) AS c FROM {name}_w GROUP BY 1, 2),
{name} AS MATERIALIZED (SELECT {key}, cell::BIGINT AS cell, CAST(c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS FLOAT)::DOUBLE AS x FROM {name}_c)"""


def cosine_routes(queries: str, qkey: str, sections: str, k: int) -> str:
    """CTE `near(query_id, section, score, rank)` from sparse `queries(qkey, cell, x)` and `sections(section, cell, x)`."""
    return f"""
qn AS (SELECT {qkey} AS query_id, sqrt(sum(x * x)) AS n FROM {queries} GROUP BY 1),
sn AS (SELECT section, sqrt(sum(x * x)) AS n FROM {sections} GROUP BY 1),
dots AS MATERIALIZED (SELECT q.{qkey} AS query_id, s.section, sum(q.x * s.x) AS dot FROM {queries} q JOIN {sections} s USING (cell) GROUP BY 1, 2),
near AS MATERIALIZED (SELECT * FROM (
         SELECT query_id, section, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section) AS rank FROM (
           SELECT qn.query_id, sn.section, round(coalesce(dot, 0) / ((qn.n + 1e-9) * (sn.n + 1e-9)), 6) + 0.0 AS score
           FROM qn CROSS JOIN sn LEFT JOIN dots ON dots.query_id = qn.query_id AND dots.section = sn.section))
         WHERE rank <= {k})"""


ROUTED = f"""
{embed("documents", "doc_id", "text", "dvec")},
{embed("benchmark", "item_id", "text", "qvec")},
svec AS MATERIALIZED (SELECT source AS section, cell, sum(x) / any_value(n) AS x
         FROM dvec JOIN documents USING (doc_id) JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) USING (source)
         GROUP BY 1, 2),
{cosine_routes("qvec", "item_id", "svec", 5)},
asked AS (SELECT query_id, section FROM near WHERE rank <= 2)"""

BM25 = f"""
{ROUTED},
doc_words AS MATERIALIZED (SELECT doc_id, source AS section, {words("lower(text)")} AS ws FROM documents),
lens AS MATERIALIZED (SELECT doc_id, section, len(ws) AS len FROM doc_words),
tf AS MATERIALIZED (SELECT doc_id, section, w, count(*) AS tf FROM (SELECT doc_id, section, unnest(ws) AS w FROM doc_words) GROUP BY ALL),
wanted AS MATERIALIZED (SELECT * FROM asked),
size AS MATERIALIZED (SELECT query_id, count(*) AS n, avg(len) AS avgdl FROM wanted JOIN lens USING (section) GROUP BY 1),
df AS MATERIALIZED (SELECT query_id, w, count(*) AS df FROM wanted JOIN tf USING (section) GROUP BY 1, 2),
idf AS MATERIALIZED (SELECT query_id, w, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df JOIN size USING (query_id)),
low AS MATERIALIZED (SELECT query_id, 0.25 * avg(idf) AS eps FROM idf GROUP BY 1),
asks AS MATERIALIZED (SELECT query_id, w, count(*) AS qtf
         FROM (SELECT item_id AS query_id, unnest({words("lower(text)")}) AS w FROM benchmark) GROUP BY 1, 2),
weights AS MATERIALIZED (SELECT query_id, section, w, qtf * CASE WHEN idf < 0 THEN eps ELSE idf END AS weight, avgdl
         FROM asks JOIN idf USING (query_id, w) JOIN low USING (query_id) JOIN size USING (query_id) JOIN wanted USING (query_id)),
bm AS MATERIALIZED (SELECT query_id, tf.doc_id, round(sum(weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score
       FROM weights JOIN tf ON tf.section = weights.section AND tf.w = weights.w JOIN lens ON lens.doc_id = tf.doc_id GROUP BY 1, 2),
bm25 AS (SELECT * FROM (SELECT query_id, doc_id AS chunk_id, score,
                               row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
                        FROM bm WHERE score > 0) WHERE rank <= 5)"""

HYBRID = f"""
{BM25},
dn AS (SELECT doc_id, sum(x * x) AS n FROM dvec GROUP BY 1),
qq AS (SELECT item_id AS query_id, sum(x * x) AS n FROM qvec GROUP BY 1),
dd AS MATERIALIZED (SELECT q.item_id AS query_id, d.doc_id, sum(q.x * d.x) AS dot FROM qvec q JOIN dvec d USING (cell) GROUP BY 1, 2),
dist AS MATERIALIZED (SELECT qq.query_id, dn.doc_id, round(greatest(qq.n + dn.n - 2 * coalesce(dot, 0), 0), 6) AS d
         FROM qq CROSS JOIN dn LEFT JOIN dd ON dd.query_id = qq.query_id AND dd.doc_id = dn.doc_id),
top50 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, doc_id) AS r FROM dist) WHERE r <= 50),
vec AS (SELECT * FROM (SELECT t.query_id, t.doc_id AS chunk_id, d AS score, row_number() OVER (PARTITION BY t.query_id ORDER BY r) AS rank
        FROM top50 t JOIN documents USING (doc_id) JOIN asked a ON a.query_id = t.query_id AND a.section = source) WHERE rank <= 5),
both_hits AS (SELECT query_id, chunk_id, 'vector' AS retrieval_source, score, rank, 0 AS src FROM vec
         UNION ALL SELECT query_id, chunk_id, 'bm25', score, rank, 1 FROM bm25),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY src, rank) AS nth FROM both_hits) WHERE nth = 1)"""

LABEL_ROUTES = f"""
cells AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS cell FROM embeddings),
centres AS (SELECT 'label ' || label AS section, cell, avg(x) AS x FROM cells GROUP BY 1, 2),
{cosine_routes("cells", "vec_id", "centres", 5)}"""

ANSWERS = f"""
answers AS (SELECT l.doc_id, CASE WHEN toxic = 1 THEN [lang, source]
                   ELSE [source, lang, 'q' || quality, source, lang] END AS a
            FROM labels l JOIN documents USING (doc_id)),
{keywords("documents")},
enriched AS (SELECT k.doc_id, CASE WHEN len(a) >= 3 THEN a ELSE k.k END AS keywords,
                    CASE WHEN len(a) >= 3 THEN 'model' ELSE 'fallback' END AS keyword_source
             FROM kw k LEFT JOIN answers USING (doc_id))"""


def pii_count_columns() -> str:
    out, x = [], "text"
    for label, pattern, masked in PII_DEFAULT:
        out.append(f"sum(len(regexp_extract_all({x}, '{pattern}')))::BIGINT AS n_{label.lower()}")
        x = f"regexp_replace({x}, '{pattern}', '{masked}', 'g')"
    return ", ".join(out)


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


ASKED = f"""
asks AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user'),
texts AS (SELECT conv_id || ':' || (n - no) AS conv_id, no, text FROM asks, (SELECT unnest([0, 1, 2]) AS no) WHERE n > no),
split AS (SELECT conv_id, no, {sentences(collapse(mask("text")))} AS s FROM texts WHERE NOT {unsafe('text')} AND {strip('text')} <> ''),
rows0 AS (SELECT conv_id, no, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM split),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, sentence ORDER BY no, pos) AS nth FROM rows0) WHERE nth = 1 OR length(sentence) < 20)"""

GOOD_EXPANSIONS = """
good AS (SELECT conv_id, string_agg(text, '|' ORDER BY no) AS e FROM passed JOIN texts USING (conv_id, no)
         WHERE no > 0 AND conv_id IN (SELECT conv_id FROM passed WHERE no = 0) GROUP BY 1)"""


def signed(rows: str) -> str:
    """`sigs` (key, s): 64 least CRC-32 values of the 5-character shingles of `rows` (key, sentence), for those with a shingle.

    The register is linear in its start, so the one after a shingle and the digits of `j` is that after the shingle, moved on
    by as many zero bytes, combined with that of the digits alone.
    """

    def fed(start: str, raw: str) -> str:
        return f"""list_reduce(list_transform(range(0, length(hex({raw})), 2), lambda i: ('0x' || substr(hex({raw}), i + 1, 2))::BIGINT),
            lambda s, b: list_reduce(range(8), lambda c, _: xor(c >> 1, (c & 1) * 3988292384), xor(s, b)), {start})"""

    zero = "list_reduce(range(8), lambda c, _: xor(c >> 1, (c & 1) * 3988292384), {})"
    return f"""
bare AS (SELECT key, regexp_replace(lower(sentence), '{WS}+', '', 'g') AS c FROM {rows}),
grams AS (SELECT DISTINCT key, substr(c, i, 5) AS g FROM (SELECT key, c, unnest(range(1, length(c) - 3)) AS i FROM bare)),
fed0 AS (SELECT g, {fed("4294967295::BIGINT", "encode(g)")} AS f0 FROM (SELECT DISTINCT g FROM grams)),
fed1 AS (SELECT g, {zero.format("f0")} AS f1 FROM fed0),
fed2 AS (SELECT g, f1, {zero.format("f1")} AS f2 FROM fed1),
perms AS (SELECT j, {fed("0::BIGINT", "encode(j::VARCHAR)")} AS k FROM (SELECT unnest(range(64)) AS j)),
least AS (SELECT key, j, min(xor(xor(CASE WHEN j < 10 THEN f1 ELSE f2 END, k), 4294967295)) AS v FROM grams JOIN fed2 USING (g), perms GROUP BY 1, 2),
sigs AS MATERIALIZED (SELECT key, list(v ORDER BY j) AS s FROM least GROUP BY 1)"""


def greedy() -> str:
    """`gone` (id, keeper, matches) of `sigs` with a column `scope`: one pass in the order of the key.

    Two signatures that agree on 55 of 64 places agree on all places of one of ten classes modulo 10.
    """
    return """
places AS (SELECT key, scope, s, b, list_filter(s, lambda _, i: (i - 1) % 10 = b) AS part FROM scoped, (SELECT unnest(range(10)) AS b)),
alike AS (SELECT DISTINCT x.key AS id, y.key AS keeper, list_sum(list_transform(range(1, 65), lambda i: (x.s[i] = y.s[i])::INT))::INT AS matches
          FROM places x JOIN places y ON x.b = y.b AND x.part = y.part AND x.scope = y.scope AND y.key < x.key),
earlier AS MATERIALIZED (SELECT id, list(keeper ORDER BY keeper) AS before, row_number() OVER (ORDER BY id) AS n FROM alike WHERE matches >= 55 GROUP BY 1),
pass AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS out, NULL::BIGINT AS id, NULL::BIGINT AS keeper
         UNION ALL
         SELECT n, CASE WHEN keeper IS NULL THEN out ELSE list_append(out, id) END, id, keeper
         FROM (SELECT e.n, p.out, e.id, list_filter(e.before, lambda k: NOT list_contains(p.out, k))[1] AS keeper
               FROM pass p JOIN earlier e ON e.n = p.n + 1)),
gone AS (SELECT id, keeper, matches FROM pass JOIN alike USING (id, keeper))"""


def split_recursively(size: int = 800, overlap: int = 150) -> str:
    """`pieces` (doc_id, place, text) of the documents, cut at blank lines, lines, spaces, characters.

    `parts` go down a level as long as they are too long.  A run of short neighbours is packed: a piece ends before the first part
    that does not fit, the next one begins with as many whole parts from its end as overlap and size allow.
    """
    return f"""
seps AS (SELECT unnest([chr(10) || chr(10), chr(10), ' ', '']) AS sep, unnest(range(4)) AS l),
parts AS (SELECT doc_id, []::BIGINT[] AS path, text AS part, 0::BIGINT AS l FROM documents WHERE {strip('text')} <> ''
          UNION ALL
          SELECT doc_id, list_append(path, i), part, l + 1
          FROM (SELECT doc_id, path, l, unnest(cut) AS part, generate_subscripts(cut, 1)::BIGINT AS i
                FROM (SELECT p.doc_id, p.path, s.l,
                             list_transform(string_split(p.part, s.sep), lambda x, n: CASE WHEN n = 1 THEN x ELSE s.sep || x END) AS cut
                      FROM parts p JOIN seps s ON s.l >= p.l AND (s.sep = '' OR contains(p.part, s.sep))
                           AND NOT (p.l <= 0 AND s.l > 0 AND contains(p.part, chr(10) || chr(10)))
                           AND NOT (p.l <= 1 AND s.l > 1 AND contains(p.part, chr(10)))
                           AND NOT (p.l <= 2 AND s.l > 2 AND contains(p.part, ' '))
                      WHERE len(p.path) = 0 OR length(p.part) >= {size}))
          WHERE part <> ''),
runs AS (SELECT *, list_slice(path, 1, len(path) - 1) AS parent,
                count(*) FILTER (length(part) >= {size}) OVER (PARTITION BY doc_id, list_slice(path, 1, len(path) - 1) ORDER BY path) AS nth
         FROM parts WHERE len(path) > 0),
packs AS (SELECT doc_id, min(path) AS place, list(part ORDER BY path) AS texts,
                 list_prepend(0, list_transform(range(1, count(*) + 1), lambda n: list_sum(list_slice(list(length(part) ORDER BY path), 1, n))))::BIGINT[] AS ends
          FROM runs WHERE length(part) < {size} GROUP BY doc_id, parent, nth),
cuts AS (SELECT doc_id, place, texts, ends, 0::BIGINT AS no, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS next, 0::BIGINT AS last FROM packs
         UNION ALL
         SELECT doc_id, place, texts, ends, no + 1, next, b, CASE WHEN b < len(texts) THEN
                    list_filter(range(next, b + 1), lambda s: ends[b + 1] - ends[s + 1] <= {overlap}
                                AND (s = b OR ends[b + 2] - ends[s + 1] <= {size}))[1] END, b
         FROM (SELECT doc_id, place, texts, ends, no, next,
                      coalesce(list_filter(range(last + 1, len(texts)), lambda e: ends[e + 2] - ends[next + 1] > {size})[1], len(texts)) AS b
               FROM cuts WHERE next IS NOT NULL)),
pieces AS (SELECT doc_id, place, no, {strip("array_to_string(list_slice(texts, a + 1, b), '')")} AS text FROM cuts WHERE no > 0)"""


def _recursive(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{select}"


_NAMED = "' ' || upper(source[1]) || lower(source[2:]) || ' (' || lang || ') '"

ORACLES: dict[str, str] = {
    "corpus_scan": f"SELECT doc_id, text, lang, source FROM documents WHERE text IS NOT NULL AND {strip('text')} <> ''",
    "page_text": _with(
        "visible AS (SELECT page_id, url, "
        + collapse(decode("regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"))
        + " AS text FROM pages)",
        "SELECT * FROM visible WHERE text <> ''",
    ),
    "page_spans": _with(spans(LENIENT_SIZES), "SELECT doc_id, pos, text, size FROM spans"),
    "topics_roundtrip": _with(
        f"{LENIENT_TOPICS}, numbered AS (SELECT row_number() OVER () AS doc_id, doc_id AS page, * EXCLUDE (doc_id) FROM topics), {keywords('numbered')}",
        "SELECT page AS doc_id, section_id, section_name, topic_id, topic_name, text, array_to_string(k, '|') AS keywords FROM numbered JOIN kw USING (doc_id)",
    ),
    "export_summary": _with(
        LENIENT_TOPICS,
        "SELECT 'success' AS status, NULL::VARCHAR AS reason, (SELECT count(*) FROM pages) AS total_pages, (SELECT count(*) FROM topics) AS total_topics",
    ),
    "incremental_scan": "SELECT doc_id, source, text FROM documents WHERE doc_id > (SELECT max(vec_id) FROM embeddings)",
    "chunk_sample": "SELECT vec_id, label::BIGINT AS label, len(embedding)::BIGINT AS embedding_len FROM embeddings ORDER BY vec_id LIMIT 2",
    "chunk_upsert": """
SELECT d.doc_id AS id, coalesce('quality ' || l.quality, d.text) AS text, d.lang AS created_at
FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT -doc_id - 1, 'quality ' || quality, 'now' FROM labels""",
    "upsert_versions": """
WITH l AS (SELECT doc_id, 'toxic ' || toxic AS text FROM labels WHERE quality = 1)
SELECT d.doc_id AS id, coalesce(l.text, d.text) AS text, CASE WHEN d.doc_id % 3 = 0 THEN 'late' ELSE d.lang END AS created_at
FROM documents d LEFT JOIN l USING (doc_id)
UNION ALL SELECT -doc_id - 1, text, 'now' FROM l""",
    "turn_append": _with(TURNS, f"SELECT conversation_id, turn, query, coalesce(answer, '{ERROR_ANSWER}') AS answer FROM pairs"),
    "normalize_text": f"SELECT doc_id, {normalize('text')} AS text FROM documents WHERE text <> ''",
    "normalize_section": _with(
        "named AS (SELECT doc_id, '  Section: ' || source || ' (' || upper(lang) || ')! ' || text AS s FROM documents)",
        f"SELECT doc_id, {section_name('s')} AS section FROM named",
    ),
    # The query's digits and ligatures are the tables' own again; these have no compatibility forms, so NFC equals NFKC.
    "nfkc_text": "SELECT doc_id, nfc_normalize(text) AS text FROM documents",
    "truncate_fields": """
SELECT doc_id, left(text, 500) AS keyword_text, left(text, 600) AS keyword_text_long, left(text, 2000) AS topic_text,
       left(text, 4000) AS retrieved, right(text, 1000) AS memory FROM documents""",
    "enriched_query": _with(
        TURNS,
        f"SELECT conversation_id, 'Long-term memory:' || chr(10) || ltm || chr(10) || chr(10) || 'Recent conversation:' || chr(10) || stm "
        f"|| chr(10) || chr(10) || 'User query:' || chr(10) || {normalize('query')} AS enriched FROM stm JOIN ltm USING (conversation_id)",
    ),
    "safety_filter": f"SELECT doc_id, text FROM documents WHERE NOT {unsafe('text')}",
    "valid_queries": f"SELECT conv_id, turn, text FROM conversations WHERE length(text) BETWEEN 1 AND 1000 AND {strip('text')} <> ''",
    "trace_lookup": "SELECT event_id, user_id, event_type, value FROM events WHERE user_id = 7",
    "pii_mask": f"SELECT doc_id, {mask('text')} AS text FROM documents",
    "pii_mask_in": f"SELECT doc_id, {mask('text', PII_INDIA)} AS text FROM documents",
    "pii_counts": f"SELECT lang, {pii_count_columns()} FROM documents GROUP BY 1",
    "section_pool": _with(
        ROUTED,
        """SELECT query_id, count(DISTINCT section) AS n_sections, count(DISTINCT source) AS n_found, count(doc_id) AS n_chunks,
                  sum(length(text))::BIGINT AS n_chars FROM asked LEFT JOIN documents ON source = section GROUP BY 1""",
    ),
    "keyword_enrich": _with(ANSWERS, "SELECT doc_id, array_to_string(keywords, '|') AS keywords, keyword_source FROM enriched"),
    "enrich_summary": _with(
        ANSWERS,
        """SELECT count(*) AS total, count(*) FILTER (keyword_source = 'model') AS from_model,
                  count(*) FILTER (keyword_source = 'fallback') AS from_fallback FROM enriched""",
    ),
    "keyword_merge": "SELECT source AS topic_id, arg_max(lang || '|' || n_chars, doc_id) AS keywords FROM documents GROUP BY 1",
    "owned_turns": """
SELECT conv_id AS conversation_id, turn, role, 200::BIGINT AS status FROM conversations
WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING max(turn) = 3)""",
    "size_histogram": _with(
        f"{spans(LENIENT_SIZES)}, {HISTOGRAM}",
        "SELECT doc_id, array_to_string(sizes, '|') AS sizes, n_spans, sizes[1] AS section_size, coalesce(sizes[2], sizes[1]) AS topic_size FROM hist",
    ),
    "distinct_sections": f"SELECT DISTINCT {strip(_NAMED)} AS section FROM documents",
    "normalized_sections": f"SELECT DISTINCT {section_name(_NAMED)} AS section FROM documents ORDER BY 1",
    "next_sequence": _with(TURNS, "SELECT conversation_id, count(*) + 1 AS next_sequence_id FROM pairs GROUP BY 1"),
    "fallback_keywords": _with(keywords("documents"), "SELECT doc_id, array_to_string(k, '|') AS keywords FROM kw"),
    "index_stats": """
SELECT 'all' AS section, count(*) AS total_elements, max(len(embedding)) AS dimension, true AS is_trained FROM embeddings
UNION ALL SELECT 'label ' || label, count(*), max(len(embedding)), true FROM embeddings GROUP BY label""",
    "batch_requests": """
SELECT (rn - 1) // 5 + 1 AS batch_no, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id, sum(n_chars)::BIGINT AS n_chars
FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) GROUP BY 1""",
    "trace_rollup": """
SELECT user_id AS trace_id, (rn - 1) // 500 + 1 AS part, string_agg(event_type || ' ' || props, '|' ORDER BY rn) AS lines
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) GROUP BY 1, 2""",
    "turn_rows": _with(
        f"""{TURNS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS sequence_id FROM pairs),
traced AS (SELECT *, CASE WHEN sequence_id = 1 THEN conversation_id::VARCHAR ELSE conversation_id || '-' || sequence_id END AS trace_id FROM numbered),
lines AS (SELECT user_id::VARCHAR AS trace_id, string_agg(event_type || ' ' || props, '|' ORDER BY ts, event_id) AS l, count(*) AS n
          FROM events GROUP BY 1)""",
        f"""SELECT trace_id, conversation_id::VARCHAR AS conversation_id, conversation_id % 7 AS user_id, sequence_id, query,
       coalesce(answer, '{ERROR_ANSWER}') AS answer, answer AS memory, md5(coalesce(l, '')) AS logs_md5, coalesce(n, 0)::BIGINT AS n_logs,
       '2024-02-01 00:00:00' AS created_at
FROM traced LEFT JOIN lines USING (trace_id)""",
    ),
    "stage_latency": """
SELECT event_type AS stage, count(value) AS n, round(avg(value), 6) AS mean_seconds, max(value) AS max_seconds,
       round(quantile_cont(value, 0.95), 6) AS p95_seconds, count(*) FILTER (value IS NULL) AS n_failed FROM events GROUP BY 1""",
    "hierarchy_topics": _with(LENIENT_TOPICS, "SELECT doc_id, section_id, section_name, topic_id, topic_name, text FROM topics"),
    "hierarchy_strict": _with(STRICT_TOPICS, "SELECT doc_id, section_id, section_name, topic_id, topic_name, text FROM topics"),
    "paragraph_numbers": _with(
        STRICT_TOPICS,
        """SELECT doc_id, topic_id, printf('P_%03d', (row_number() OVER (PARTITION BY doc_id ORDER BY first_pos))::INT) AS paragraph_id
           FROM topics WHERE text <> ''""",
    ),
    "chunk_ids": _with(LINES, "SELECT id, doc_id, index_in_para, chunk_text FROM lines"),
    "chunk_links": _with(
        LINES,
        """SELECT id, lag(id) OVER w AS prev_chunk_id, lead(id) OVER w AS next_chunk_id FROM lines
           WINDOW w AS (PARTITION BY doc_id, section ORDER BY id)""",
    ),
    "chunk_confidence": _with(SCORED, "SELECT id, confidence_score FROM scored"),
    "context_window": _with(
        WINDOWS,
        """SELECT id, string_agg(cid::VARCHAR, '|' ORDER BY cid) AS context_ids, md5(string_agg(ctext, chr(10) ORDER BY cid)) AS text_md5
           FROM near GROUP BY 1""",
    ),
    "unique_texts": _with(
        f"""{WINDOWS},
flat AS (SELECT doc_id, index_in_para AS p, 0 AS i, own AS text FROM near UNION SELECT doc_id, index_in_para, cid, ctext FROM near),
seen AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY p, i) AS nth FROM flat)""",
        "SELECT doc_id AS query_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, i) AS text_no, text FROM seen WHERE nth = 1",
    ),
    "short_term_memory": _with(TURNS, "SELECT conversation_id, stm FROM stm"),
    "long_term_memory": _with(TURNS, "SELECT conversation_id, ltm FROM ltm"),
    "memory_tail": _with(
        TURNS, "SELECT conversation_id, right(string_agg(said, chr(10) ORDER BY seq), 1000) AS memory FROM turns GROUP BY 1"
    ),
    "exact_dedup": _with(f"{SENTENCES}, {FIRST_SENTENCES}", "SELECT doc_id, pos, sentence FROM firsts"),
    "clean_documents": _with(
        f"{SAFE_SENTENCES}, {FIRST_SENTENCES}",
        "SELECT * FROM (SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS text FROM firsts GROUP BY 1) WHERE length(text) > 5",
    ),
    "minhash_signature": _with(
        f"""{SENTENCES}, {FIRST_SENTENCES},
keyed AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos, sentence) AS key FROM firsts), {signed("keyed")}""",
        "SELECT doc_id, pos, array_to_string(s, '|') AS signature FROM keyed LEFT JOIN sigs USING (key)",
    ),
    "near_dup_pairs": _recursive(
        f"""{SENTENCES}, {FIRST_SENTENCES},
keyed AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) AS key FROM firsts WHERE length(sentence) >= 20), {signed("keyed")},
scoped AS (SELECT *, 0 AS scope FROM sigs), {greedy()}""",
        "SELECT id, keeper, matches FROM gone",
    ),
    "near_dedup": _recursive(
        f"""{SAFE_SENTENCES}, {FIRST_SENTENCES},
keyed AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) AS key FROM firsts),
long AS (SELECT * FROM keyed WHERE length(sentence) >= 20), {signed("long")},
scoped AS (SELECT *, 0 AS scope FROM sigs), {greedy()}""",
        "SELECT doc_id, pos, sentence FROM keyed WHERE key NOT IN (SELECT id FROM gone)",
    ),
    "recursive_chunks": _recursive(
        split_recursively(),
        """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place, no) AS index_in_para, text AS chunk_text
           FROM pieces WHERE text <> ''""",
    ),
    "chunk_invariants": f"""
SELECT doc_id, 0::BIGINT AS n_oversize, 0::BIGINT AS n_unstripped, true AS numbered, true AS starts_right, true AS ends_right, true AS covers
FROM documents WHERE {strip('text')} <> ''""",
    "knn_l2": _with(L2, "SELECT query_id, vec_id, d AS score, rank FROM l2"),
    "ivf_exact": _with(L2, "SELECT query_id, vec_id, d AS score, rank FROM l2"),
    "ann_lsh": _with(lsh_tables(1, 4, 4), "SELECT query_id, vec_id, d AS score, rank FROM near_met WHERE rank <= 5"),
    "ann_lsh_tables": _with(lsh_tables(8, 4, 2), "SELECT query_id, vec_id, d AS score, rank FROM near_met WHERE rank <= 5"),
    "index_updates": """
SELECT vec_id, CASE WHEN vec_id % 14 = 0 THEN 0 WHEN vec_id % 10 = 1 THEN label + 1 ELSE label END::BIGINT AS cell,
       round(list_sum(embedding::DOUBLE[]), 6) AS total
FROM embeddings WHERE CASE WHEN vec_id % 14 = 0 THEN true ELSE vec_id % 7 <> 0 AND vec_id % 11 <> 3 END""",
    "knn_cosine": _with(
        VECTORS,
        """SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
             SELECT q.vec_id AS query_id, d.vec_id, round(list_inner_product(q.u, d.u), 6) + 0.0 AS score FROM unit q, unit d)) WHERE rank <= 5""",
    ),
    "vector_normalize": """
WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (label + 1)) AS v FROM embeddings)
SELECT vec_id, pos - 1 AS pos, round(x / (n + 1e-9), 6) + 0.0 AS x FROM (
  SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos, sqrt(list_inner_product(v, v)) AS n FROM v)""",
    "knn_by_section": _with(L2, "SELECT query_id, vec_id, d AS score, rank FROM bysec"),
    "knn_by_section_legacy": _with(
        f"""{PAIRS},
each AS (SELECT *, row_number() OVER (PARTITION BY query_id, section ORDER BY d, vec_id) AS r FROM pairs WHERE label IN (l0, l1)),
far AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, vec_id) AS rank FROM each WHERE r <= 5)""",
        "SELECT query_id, vec_id, d AS score, rank FROM far WHERE rank <= 5",
    ),
    "knn_sections_default": _with(
        f"""{VECTORS},
placed AS (SELECT u.vec_id, u.u, CASE WHEN e.label <= 6 THEN e.label ELSE -1 END AS s FROM unit u JOIN embeddings e USING (vec_id)),
asks AS (SELECT vec_id, label AS s FROM embeddings
         UNION SELECT vec_id, CASE WHEN label % 2 = 0 THEN -1 ELSE (label + 1) % 10 END FROM embeddings)""",
        """SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
             SELECT q.vec_id AS query_id, d.vec_id, round(list_inner_product(q.u, d.u), 6) + 0.0 AS score
             FROM asks a JOIN unit q USING (vec_id) JOIN placed d ON d.s = a.s)) WHERE rank <= 5""",
    ),
    "flat_search": _with(
        f"""{PAIRS},
own AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS r FROM pairs WHERE label = l0),
firsts AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY query_id) AS nth FROM own WHERE r <= 10)""",
        "SELECT query_id, vec_id, d AS score FROM firsts WHERE nth = 1 ORDER BY d, vec_id, query_id LIMIT 10",
    ),
    "hybrid_merge": _with(
        f"""{L2},
hits AS (SELECT query_id, vec_id, rank, 0 AS src, 'vector' AS retrieval_source FROM l2
         UNION ALL SELECT query_id, vec_id, rank, 1, 'bm25' FROM bysec),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, vec_id ORDER BY src, rank) AS nth FROM hits) WHERE nth = 1)""",
        """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY src, rank) AS position, vec_id AS chunk_id, retrieval_source FROM once""",
    ),
    "section_pref": _with(
        f"""{L2},
firsts AS (SELECT query_id, section, min(rank) AS r FROM l2 GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS nth FROM firsts)""",
        "SELECT query_id, string_agg(section, '|' ORDER BY r) AS sections FROM best WHERE nth <= 2 GROUP BY 1",
    ),
    "bm25_search": _with(BM25, "SELECT query_id, chunk_id, score, rank FROM bm25"),
    "bm25_postings": _with(BM25, "SELECT query_id, chunk_id, score, rank FROM bm25"),
    "hybrid_search": _with(
        HYBRID,
        """SELECT query_id, chunk_id, retrieval_source, score,
                  row_number() OVER (PARTITION BY query_id ORDER BY src, rank) AS position FROM once""",
    ),
    "rerank_overlap": _with(
        f"""{BM25},
sets AS (SELECT b.query_id, b.chunk_id, list_distinct({words("lower(q.text)")}) AS a, list_distinct({words("lower(d.text)")}) AS b
         FROM bm25 b JOIN benchmark q ON q.item_id = b.query_id JOIN documents d ON d.doc_id = b.chunk_id),
scored AS (SELECT query_id, chunk_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS rerank_score FROM sets)""",
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rank FROM scored)
           WHERE rank <= 3""",
    ),
    "route_queries": _with(
        LABEL_ROUTES,
        """SELECT query_id, string_agg(section, '|' ORDER BY rank) AS candidates,
                  string_agg(section, '|' ORDER BY rank) FILTER (rank <= 2) AS sections FROM near GROUP BY 1""",
    ),
    "route_threshold": _with(
        f"""{LABEL_ROUTES},
good AS (SELECT query_id, string_agg(section, '|' ORDER BY rank) AS s FROM near WHERE rank <= 2 AND score >= 0.55 GROUP BY 1)""",
        """SELECT vec_id AS query_id, coalesce(s, 'label 0|label 1') AS candidates, coalesce(s, 'label 0|label 1') AS sections
           FROM embeddings LEFT JOIN good ON vec_id = query_id""",
    ),
    "route_named": _with(
        f"""
known AS (SELECT DISTINCT {section_name("source || ' ' || lang")} AS section FROM documents),
first AS (SELECT list(section ORDER BY section)[:2] AS s FROM known),
raw AS (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN [upper(source) || '  (' || lang || ')!']
          WHEN 2 THEN ['the ' || source || ' pages', lang || ' ' || lang]
          WHEN 3 THEN ['nothing like it', source || ' ' || lang, lang || ' ' || source] END AS names,
        lang || ' of ' || source AS query FROM documents),
mentions AS MATERIALIZED (SELECT doc_id, pos, CASE WHEN own THEN name ELSE {section_name("name")} END AS name FROM (
  SELECT doc_id, names IS NULL AS own, unnest(coalesce(names, [query])) AS name,
         generate_subscripts(coalesce(names, [query]), 1) AS pos FROM raw)),
asks AS (SELECT DISTINCT name FROM mentions),
{embed("asks", "name", "name", "avec")},
{embed("known", "section", "section", "svec")},
{cosine_routes("avec", "name", "svec", 2)},
alike AS (SELECT query_id AS name, list(section ORDER BY rank) AS s FROM near WHERE score >= 0.55 GROUP BY 1),
matches AS (SELECT a.name, CASE WHEN k.section IS NOT NULL THEN list_concat([a.name], list_filter(coalesce(m.s, []), lambda x: x <> a.name))
              ELSE coalesce(m.s, first.s) END AS s
            FROM asks a CROSS JOIN first LEFT JOIN alike m USING (name) LEFT JOIN known k ON k.section = a.name),
flat AS (SELECT doc_id, pos, unnest(s) AS section, generate_subscripts(s, 1) AS at_place FROM mentions JOIN matches USING (name)),
once AS (SELECT doc_id, section, min((pos, at_place)) AS place FROM flat GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS r FROM once)""",
        "SELECT doc_id AS query_id, string_agg(section, '|' ORDER BY r) AS sections FROM ranked WHERE r <= 2 GROUP BY 1",
    ),
    "rerank_model": """
WITH firsts AS (SELECT conv_id, arg_min(text, turn) AS query FROM conversations GROUP BY 1),
pairs AS (SELECT conv_id AS query_id, turn AS position, length(query) AS q, length(text) AS t FROM conversations JOIN firsts USING (conv_id)),
judged AS (SELECT query_id, position, round(-abs(q - t) / (q + t + 1), 6) + 0.0 AS score,
                  bool_and(t % 11 <> 0) OVER (PARTITION BY query_id) AS scored FROM pairs)
SELECT query_id, position, CASE WHEN scored THEN score END AS rerank_score,
       row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN scored THEN -score END, position) AS rank, scored
FROM judged QUALIFY rank <= 5""",
    "keyword_answers": _with(
        f"""{keywords("documents")},
batches AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 3 AS b FROM documents),
moods AS (SELECT b, bool_or(doc_id % 35 = 0) AS down, bool_or(doc_id % 7 = 0) AS slow FROM batches GROUP BY 1)""",
        """SELECT doc_id, CASE WHEN down THEN array_to_string(k, '|') ELSE 'T' || doc_id || ' a|T' || doc_id || ' b|c' END AS keywords,
       CASE WHEN down THEN 'fallback' ELSE 'model' END AS keyword_source, CASE WHEN down THEN 3 WHEN slow THEN 2 ELSE 1 END::BIGINT AS attempts
FROM kw JOIN batches USING (doc_id) JOIN moods USING (b)""",
    ),
    "embed_hashing": _with(
        f"{embed('documents', 'doc_id', 'text', 'cells')}, dvec AS (SELECT doc_id, cell AS pos, x FROM cells)",
        """SELECT doc_id AS chunk_id, pos, round(coalesce(x, 0), 6) AS x FROM (SELECT doc_id, unnest(range(64)) AS pos FROM documents)
           LEFT JOIN dvec USING (doc_id, pos)""",
    ),
    "keyword_requests": """
SELECT (rn - 1) // 3 + 1 AS batch_no, to_json(list({'topic_id': 'T' || doc_id, 'text': left(text, 500)} ORDER BY rn))::VARCHAR AS payload
FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) GROUP BY 1""",
    "parse_model_output": f"""
SELECT doc_id,
       array_to_string(list_slice(list_transform(list_filter(string_split(text, chr(10)), lambda l: {strip('l')} <> ''),
                       lambda l: {strip("trim(l, '- ')")}), 1, 2), '|') AS lines,
       source || '|' || lang AS listed, 'a|b' AS unlisted, lang || '|x' AS mapped, 0::BIGINT AS n_unmapped
FROM documents""",
    "prompt_assembly": _with(
        f"""{TURNS},
hits AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'context' ELSE role END AS src, text FROM conversations),
parts AS (SELECT conv_id, string_agg('[' || upper(src) || '] ' || text, chr(10) ORDER BY turn) FILTER (src <> 'context') AS p,
                 string_agg('[' || upper(src) || '] ' || text, chr(10) ORDER BY turn) FILTER (src = 'context') AS c,
                 string_agg('--- Context Block ' || (turn + 1) || ' (Source: ' || src || ') ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS context,
                 string_agg('[Doc ' || (turn + 1) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS docs
          FROM hits GROUP BY 1)""",
        """SELECT conversation_id AS query_id, 'Primary data:' || chr(10) || coalesce(p, 'No direct data.') || chr(10) || chr(10)
              || 'Background:' || chr(10) || coalesce(c, 'No extra context.') || chr(10) || chr(10)
              || 'Memory:' || chr(10) || '- LTM: ' || ltm || chr(10) || '- STM: ' || stm || chr(10) || chr(10)
              || 'Question:' || chr(10) || query AS prompt, context, docs
           FROM parts JOIN stm ON stm.conversation_id = conv_id JOIN ltm USING (conversation_id)""",
    ),
    "expansion_guard": _with(
        f"{ASKED}, passed AS (SELECT conv_id, no FROM kept GROUP BY 1, 2 HAVING sum(length(sentence) + 1) - 1 > 5), {GOOD_EXPANSIONS}",
        "SELECT t.conv_id AS query_id, coalesce(e, t.text) AS expansions FROM texts t LEFT JOIN good USING (conv_id) WHERE no = 0",
    ),
    "expansion_guard_turns": _recursive(
        f"""{ASKED},
keyed AS (SELECT *, row_number() OVER (ORDER BY conv_id, no, pos) AS key FROM kept),
long AS (SELECT * FROM keyed WHERE length(sentence) >= 20), {signed("long")},
scoped AS (SELECT sigs.*, conv_id AS scope FROM sigs JOIN keyed USING (key)), {greedy()},
passed AS (SELECT conv_id, no FROM keyed WHERE key NOT IN (SELECT id FROM gone) GROUP BY 1, 2 HAVING sum(length(sentence) + 1) - 1 > 5),
{GOOD_EXPANSIONS}""",
        "SELECT t.conv_id AS query_id, coalesce(e, t.text) AS expansions FROM texts t LEFT JOIN good USING (conv_id) WHERE no = 0",
    ),
}
