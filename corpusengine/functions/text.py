"""Text predicates, masks, scores and model-answer parsing as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusengine.functions.arrays import let, most_frequent
from corpusengine.functions.arrow import nfkc_udf

# The characters Python's str.split and \s treat as whitespace, written so that
# Java and RE2 read the class alike.
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WS_INNER = WS[1:-1]
# The same characters as a plain string.
WS_CHARS = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)

# Phrases and words that make a text unsafe.
INJECTION_PHRASES = (
    "ignore all previous instructions",
    "system prompt",
    "forget everything",
    "bypass safety",
    "dan mode",
)
HARMFUL_WORDS = ("bomb", "exploit", "hack", "kill", "suicide")

# Masking patterns, applied in this order.
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PII_DEFAULT = (
    ("EMAIL", EMAIL, "[EMAIL]"),
    (
        "PHONE",
        r"\+?\d{1,4}?[-.\s]?\(?\d{1,3}?\)?[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}",
        "[PHONE]",
    ),
    ("ADHAAR", r"\b\d{4}\s\d{4}\s\d{4}\b", "[ADHAAR]"),
    ("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]{1}\b", "[PAN]"),
)
PII_INDIA = (
    ("EMAIL", EMAIL, "[EMAIL_MASKED]"),
    ("PHONE", r"(\+91[\-\s]?)?[6-9]\d{9}", "[PHONE_MASKED]"),
    ("AADHAAR", r"\b\d{4}\s?\d{4}\s?\d{4}\b", "[AADHAAR_MASKED]"),
)

# Fallback keyword vocabulary.
KEYWORD_STOPWORDS = ("this", "that", "with", "from", "have", "will", "your")
DEFAULT_KEYWORDS = ("Banking", "Loan", "Finance", "Customer", "Policy")

# Fixed value: where a text is cut into sentences.
SENTENCE_BREAK = r"(?<=[.!?]) +"


def strip(c: Column) -> Column:
    """Without white space at the ends; looks at the ends only."""
    return F.btrim(c, F.lit(WS_CHARS))


def collapse(c: Column) -> Column:
    """Whitespace runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def normalize(c: Column) -> Column:
    """Query normal form: lower case, single spaces, never null."""
    return collapse(F.lower(F.coalesce(c, F.lit(""))))


def normalize_batch(df: DataFrame, col: str) -> DataFrame:
    """Drop null and empty texts, then put `col` into query normal form."""
    return df.where(F.col(col).isNotNull() & (F.col(col) != "")).withColumn(col, normalize(F.col(col)))


def normalize_section(c: Column) -> Column:
    bare = F.regexp_replace(strip(F.lower(c)), rf"[^\p{{L}}\p{{N}}_{WS_INNER}]", "")
    return F.when(c.isNull() | (c == ""), F.lit("default")).otherwise(
        F.regexp_replace(bare, f"{WS}+", " ")
    )


def nfkc(c: Column) -> Column:
    """NFKC; pure-ASCII values never leave the JVM because the function receives null for them."""
    return F.coalesce(nfkc_udf(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def head(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def tail(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(f"[^{WS_INNER}]")


def words(c: Column) -> Column:
    """Whitespace-delimited tokens of the text, no empty tokens."""
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def is_unsafe(c: Column) -> Column:
    """An injection phrase anywhere, or a harmful word as a whole token."""

    def check(low: Column) -> Column:
        phrase = reduce(or_, [low.contains(p) for p in INJECTION_PHRASES])
        # The substring test guards the tokenisation, so clean texts are never split.
        inside = reduce(or_, [low.contains(w) for w in HARMFUL_WORDS])
        tokens = F.split(low, f"{WS}+")
        return phrase | (inside & F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in HARMFUL_WORDS])))

    return let(F.lower(c), check)


def is_valid_query(c: Column, max_chars: int = 1000) -> Column:
    return c.isNotNull() & F.length(c).between(1, max_chars) & (strip(c) != "")


def _unicode(pattern: str) -> str:
    return "(?U)" + pattern


def mask_pii(c: Column, patterns=PII_DEFAULT) -> Column:
    for _, pattern, label in patterns:
        c = F.regexp_replace(c, _unicode(pattern), label)
    return c


def pii_counts(c: Column, patterns=PII_DEFAULT) -> Column:
    """Struct of match counts per label, each counted on the text masked so far."""
    fields = []
    for label, pattern, mask in patterns:
        fields.append(F.regexp_count(c, F.lit(_unicode(pattern))).cast("bigint").alias(label.lower()))
        c = F.regexp_replace(c, _unicode(pattern), mask)
    return F.struct(*fields)


def sentences(c: Column) -> Column:
    """Sentences of a whitespace-collapsed text."""
    return F.filter(F.split(c, SENTENCE_BREAK), lambda s: s != "")


def fallback_keywords(
    c: Column,
    n: int = 5,
    min_len: int = 4,
    stopwords=KEYWORD_STOPWORDS,
    defaults=DEFAULT_KEYWORDS,
) -> Column:
    """The `n` most frequent plain words, padded with the default keywords."""
    # A token is a run of letters, digits and underscores; one pass finds those of plain letters only.
    token = rf"(?<![\p{{L}}\p{{N}}_])[a-z]{{{min_len},}}+(?![\p{{L}}\p{{N}}_])"
    plain = F.filter(F.regexp_extract_all(F.lower(c), F.lit(token), F.lit(0)), lambda w: ~w.isin(*stopwords))
    padded = F.concat(most_frequent(plain, n), F.array(*[F.lit(d) for d in defaults]))
    return F.slice(padded, 1, n)


def confidence(text: Column, keywords: Column) -> Column:
    """Quality score in [0, 1] from length, keyword hits and sentence ending."""
    # Lengths, parts and weights of the score.
    n = F.size(keywords)
    hits = let(F.lower(text), lambda low: F.size(F.filter(keywords, lambda k: (k != "") & F.contains(low, F.lower(k)))))
    length_part = F.when(F.length(text).between(80, 200), 1.0).otherwise(0.6)
    keyword_part = F.when(keywords.isNull() | (n == 0), 0.5).otherwise(hits / n)
    end_part = F.when(strip(text).rlike("[.!?]$"), 1.0).otherwise(0.7)
    score = F.round(0.5 * length_part + 0.3 * keyword_part + 0.2 * end_part, 3)
    return F.when(text.isNull() | (text == ""), 0.0).otherwise(score)


def context_radius(score: Column) -> Column:
    # The scores from which a chunk needs less context.
    return F.when(score >= 0.85, 1).when(score >= 0.6, 2).otherwise(3)


_KEYWORD_MAP = "map<string,array<string>>"


def parse_json_map(raw: Column) -> Column:
    """JSON object of keyword lists; on failure the part between code fences; else empty."""
    inner = F.regexp_extract(strip(raw), r"(?s)^```(?:json)?(.*?)(?:```|$)", 1)
    empty = F.from_json(F.lit("{}"), _KEYWORD_MAP)
    return F.coalesce(F.from_json(raw, _KEYWORD_MAP), F.from_json(strip(inner), _KEYWORD_MAP), empty)


def parse_list(raw: Column, fallback: Column, n: int = 2) -> Column:
    """First `n` items of the JSON array between the first `[` and the last `]`."""
    body = F.regexp_extract(raw, r"(?s)\[.*\]", 0)
    parsed = F.when(body != "", F.from_json(body, "array<string>"))
    return F.slice(F.coalesce(parsed, fallback), 1, n)


def parse_lines(raw: Column, n: int = 2) -> Column:
    """First `n` non-blank lines without list dashes."""
    lines = F.filter(F.split(raw, "\n"), lambda l: strip(l) != "")
    return F.slice(F.transform(lines, lambda l: strip(F.btrim(l, F.lit("- ")))), 1, n)
