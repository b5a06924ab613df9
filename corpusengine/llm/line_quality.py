"""Line-first cleaning: rules per line, then a verdict on what the document lost.

DataFrame functions only; all of a document is judged inside its row, nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusengine.functions.arrays import let
from corpusengine.llm.common import SPACES, col, replaced, text_of

SYMBOLS = "#*$%&|<>"
#: Characters of a line that count against it: at most one in ten.
MARKS = SYMBOLS + "!"
#: A line of prose has a sentence end somewhere.
ENDS = r"[.!?…。！？]"
#: A menu has at least so many separators in a line.
MENU = 3
NAVIGATION = r"^(home|menu|next|previous|prev|back|search|log ?in|sign ?in|sign ?up|share|skip to|read more|see also)\b.{0,40}$"
BOILERPLATE = (
    r"lorem ipsum|javascript|cookie policy|use of cookies|uses cookies|terms of (use|service)|privacy policy|"
    r"all rights reserved|click here|subscribe to|sign up for|follow us on"
)
FIRST_LETTERS = "".join(sorted({phrase[0] for phrase in BOILERPLATE.split("|") if phrase[0].isalpha()}))
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_LOSS_PERCENT = 40


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` in order."""
    return F.array_remove(F.split(text, rf"[{SPACES}]+"), "")


def _count(text: Column, characters: str) -> Column:
    # A pattern that finds nothing leaves the text as it is; `translate` looks every character up.
    return F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]+", ""))


def solid(text: Column) -> Column:
    """Code points that are not white space."""
    return F.length(F.translate(text, SPACES, ""))


def line_passes(line: Column) -> Column:
    """Punctuation, navigation and boilerplate rules; a line without a word passes."""
    # `(?i)` stands for A-Z only; the letter ahead is looked at before all the phrases are tried.
    return let(
        F.btrim(line, F.lit(SPACES)),
        lambda s: (F.length(s) == 0)
        | (
            (_count(s, MARKS) * 10 <= F.length(s))
            & s.rlike(ENDS)
            & (_count(s, "|›»•") < MENU)
            & ~s.rlike(f"(?i){NAVIGATION}")
            & ~s.rlike(f"(?i)(?=[{FIRST_LETTERS}])(?:{BOILERPLATE})")
        ),
    )


def repeated_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, the first included.

    Windows are compared by 64-bit hashes, sorted with their positions; only texts with
    a repeat are sorted.  `n` different windows are mistaken with odds of `n * n / 2 ** 65`.
    """
    windows = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(windows, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
        twice = let(
            placed,
            lambda s: F.filter(
                s, lambda x, i: (F.get(s, i - 1)["v"] == x["v"]) | (F.get(s, i + 1)["v"] == x["v"])
            ),
        )
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(
            starts,
            lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
                F.lit(0),
                lambda a, b: a + b,
            ),
        )

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACES}]")),
        lambda x: F.size(x) - F.size(F.array_distinct(x)),
    )


def measured(text: Column) -> Column:
    """Struct of the document's counts, its text without failed lines, and the verdicts.

    A null or empty text has no words, fails `base_failed` and is not kept.
    """
    lines = F.split(text, "\n")
    cleaned = F.array_join(F.filter(lines, line_passes), "\n")
    counts = let(
        words(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")),
    )

    def verdicts(c: Column, t: Column, size: Column) -> Column:
        failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED_PERCENT * c["n_words"])
        enough = (t == text) | (100 * solid(t) >= (100 - MAX_LOSS_PERCENT) * size)
        return F.struct(
            c["n_words"].alias("n_words"),
            size.cast("long").alias("word_chars"),
            _count(text, SYMBOLS).cast("long").alias("n_symbols"),
            repeated_lines(text).cast("long").alias("n_dup_lines"),
            c["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & enough).alias("kept"),
            t.alias("cleaned"),
        )

    return let(counts, lambda c: let(cleaned, lambda t: let(solid(text), lambda size: verdicts(c, t, size))))


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` in `doc` and what `measured` says of each in `rules`.

    Every row is judged by itself, so nulls in other columns, repeated rows, an empty table
    and further columns make no difference.
    """
    packed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("doc"), text_of(text).alias("t"))
    # As a generator's result: a filter on a plain column would be moved below it and judge each text twice.
    return packed.select("doc", F.explode_outer(F.array(measured(F.col("t")))).alias("rules"))


def clean(docs: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """The documents that pass, with the columns of `docs`: failed lines are gone from their texts."""
    kept = judged(docs, text).where("rules.kept")
    columns = replaced(docs, text, F.col("rules.cleaned"), size)
    names = [c if n in (text, size) else F.col("doc")[n].alias(n) for n, c in zip(docs.columns, columns, strict=True)]
    return kept.select(*names)


def report(docs: DataFrame, text: str = "text") -> DataFrame:
    """`doc_id`, the counts and the verdicts of every row."""
    return judged(docs, text).select(
        F.col("doc")["doc_id"].alias("doc_id"),
        *[f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
    )
