import hashlib
import re
from collections import Counter

from corpusengine.llm import line_dedup, line_quality
from corpusengine.llm.common import ROW, SPLITS, col, numbered
from tests.llm.conftest import ODD_TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = " ".join(f"Word{i} and{i} more{i} of{i} this{i} kind{i}." for i in range(12))
TEXTS = [
    PROSE, PROSE + "\nHome | About | News | Contact", "Please enable JavaScript.\n" + PROSE, "### !!! ### &&&\n" * 30 + PROSE,
    "a b c " * 30, PROSE + "\n" + PROSE, PROSE.replace(".", ""), *ODD_TEXTS,
]


def lower(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


def repeats(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)})


def test_quality_against_plain_rules(make_docs, tmp_path):
    docs = make_docs(TEXTS, tmp_path)
    got = {r.doc_id: r for r in line_quality.report(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        words, r = WORD.findall(text or ""), got[i]
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeats(words))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * want[4] > 50 * len(words))
    assert [got[i].kept for i in range(7)] == [True, True, True, False, False, False, False]
    kept = {r.doc_id: r for r in line_quality.clean(docs).collect()}
    assert kept.keys() == {0, 1, 2} and {r.text for r in kept.values()} == {PROSE} and kept[1].n_chars == len(PROSE)
    assert line_quality.clean(docs).columns == docs.columns
    assert line_quality.report(make_docs([], tmp_path)).count() == 0


def test_quality_reads_letters_of_any_case_by_few_slow_passes(make_docs, tmp_path):
    bad = ["CLICK Here now.", "Lorem IPSUM dolor.", "Sign In to see.", "All Rights reserved.", "a | b | c | d.", "Terms OF Service apply."]
    good = ["Cliсk here in Cyrillic.", "Cooĸie policy of a sort.", "some first part | some second part.", "\r\x0b", "\u212Aookie policy; coo\u212Aie policy."]
    docs = make_docs([PROSE + "\n" + x for x in bad + good], tmp_path)
    assert [r.text.count("\n") for r in sorted(line_quality.clean(docs).collect())] == [0] * len(bad) + [1] * len(good)
    # `translate` looks up character by character; only the white space of the whole text and of what is left is taken out by it.
    plan = line_quality.report(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 2


def test_line_dedup_against_plain_rules(make_docs, tmp_path):
    shared = [f"own {i}\n  Shared LINE \n\nshared line\nend {i % 3}" for i in range(12)]
    texts, ids = [*shared, *ODD_TEXTS], [*range(11), None, *[50] * len(ODD_TEXTS)]
    docs = make_docs(texts, tmp_path, ids)

    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    want = []
    for i, t in zip(ids, texts, strict=True):
        lines = (t or "").split("\n")
        left = [x for x in lines if n[key(x)] < 10]
        want.append((i is None, i or 0, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    got = [(r.doc_id is None, r.doc_id or 0, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.report(docs).collect()]
    assert sorted(got) == sorted(want) and any(w[3] for w in want)
    cleaned = line_dedup.clean(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(texts)
    empty = make_docs([], tmp_path)
    assert line_dedup.report(empty).count() == 0 and line_dedup.clean(empty).count() == 0


def test_row_numbers_do_not_move_with_the_cores(spark, make_docs, tmp_path):
    docs = make_docs([f"text {i}" for i in range(50)], tmp_path)
    before = spark.conf.get(SPLITS, None)
    spark.conf.unset(SPLITS)
    try:
        first = {r.doc_id: r[ROW] for r in numbered(docs, col("doc_id")).collect()}
        assert int(spark.conf.get(SPLITS)) == spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", 1)  # as if the other cores were gone
        assert {r.doc_id: r[ROW] for r in numbered(docs, col("doc_id")).collect()} == first
        spark.conf.set(SPLITS, 3)
        numbered(docs).collect()
        assert spark.conf.get(SPLITS) == "3"
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset(SPLITS) if before is None else spark.conf.set(SPLITS, before)
