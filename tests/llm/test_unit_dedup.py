import os
import random
import re

from corpusengine.llm import unit_dedup as U
from tests.llm.conftest import ODD_TEXTS

P = "The quick brown fox jumps over the lazy dog near the old mill. It runs on through green fields until the evening comes! Then it sleeps well."


def split(text):
    out = []
    for line in re.finditer(r"[^\n]+", text or ""):
        at = line.start()
        for piece in re.split(r"(?<=[.!?…。！？])(?=\s)", line[0]):
            if piece.split():
                out.append((at, at + len(piece), " ".join(piece.lower().split())))
            at += len(piece)
    return out


def brute(rows, min_words):
    """Spans by `(row, start, end)` from one pass in rank order."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), set()
    for i in order:
        run = []
        for u in [*split(rows[i][1]), None]:
            if u is not None and u[2] in seen:
                run.append(u)
                continue
            if run and sum(len(x[2].split()) for x in run) >= min_words:
                out.add((i, run[0][0], run[-1][1]))
            run = []
            if u is not None:
                seen.add(u[2])
    return out


def test_spans_against_brute_force(make_docs, tmp_path):
    texts = [P, "Intro here. " + P + " Tail.", P.upper().replace(" ", "  "), "Same short. Same short.", *ODD_TEXTS, P + "\n" + P, P]
    ids = [9, 3, 5, 4, *range(20, 20 + len(ODD_TEXTS)), None, 3]
    docs = make_docs(texts, tmp_path, ids)
    stored = [(r.doc_id, r.text) for r in docs.collect()]
    got = {(r[0], r.start, r.end): r for r in U.repeated_spans(docs).collect()}
    numbers = sorted(r[U.ROW] for r in U.numbered(docs).collect())
    assert {(numbers.index(row), a, b) for row, a, b in got} == brute(stored, U.MIN_RUN_WORDS)
    assert all(r.kept_doc_id == 3 for r in got.values() if r.doc_id in (9, 5))


def test_text_left_and_offsets(make_docs, tmp_path):
    texts = [P, "Intro here. " + P + " Tail.", *ODD_TEXTS]
    for r in U.without_repeats(make_docs(texts, tmp_path)).collect():
        text = r.doc.text or ""
        at, left = 0, ""
        for s in r.removed:
            left += text[at : s.start]
            at = s.end
        assert r.kept == left + text[at:]
        if r.doc.doc_id == 1:
            assert r.kept == "Intro here. Tail.".replace(". ", ".") or r.kept.split() == ["Intro", "here.", "Tail."]
    assert U.without_repeats(make_docs([], tmp_path)).count() == 0


def brute_words(rows, size):
    """Marked words by row: of units and of `size`-word windows seen before, in rank order, in runs of `size` at least."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    units, windows, out = set(), {}, {}
    for i in order:
        words = (rows[i][1] or "").lower().split()
        marked, at = set(), 0
        for _, _, unit in split(rows[i][1]):
            n = len(unit.split())
            if unit in units:
                marked |= set(range(at, at + n))
            units.add(unit)
            at += n
        for a in range(len(words) - size + 1):
            window = tuple(words[a : a + size])
            row, place = windows.setdefault(window, (i, a))
            periodic = any(window[p:] == window[:-p] for p in range(1, size // 2 + 1))
            if row != i or (a >= place + size and not periodic):
                marked |= set(range(a, a + size))
        ends = [w for w in range(len(words) + 1) if w not in marked]
        out[i] = {w for a, b in zip([-1, *ends], ends) if b - a > size for w in range(a + 1, b)}
    return out


def test_passages_pasted_in_mid_sentence(make_docs, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(500)}{rng.choice(['', '', '', '', '.', ' \n', ' '])}" for _ in range(200)) for _ in range(40)]
    for n in (24, 25, 26, 50, 51, 80, 99):
        for _ in range(6):
            source, target = rng.sample(range(40), 2)
            words = texts[source].split()
            a = rng.randrange(len(words) - n)
            passage = " ".join(words[a : a + n]).replace(".", "")
            at = rng.randrange(20, 180)
            for i, text in ((source, texts[source]), (target, texts[target])):
                kept = text.split(" ")
                texts[i] = " ".join(kept[:at]) + "  " + (passage.upper() if i == target else passage) + " " + " ".join(kept[at:])
    twice = " ".join(f"v{i}" for i in range(40))
    texts += [f"one {twice} two {twice} three", "a b c " * 60, "x " + "a b c " * 60, twice + " four"]
    docs = make_docs(texts, tmp_path)
    stored = [(r.doc_id, r.text) for r in docs.collect()]
    numbers = sorted(r[U.ROW] for r in U.numbered(docs).collect())
    got = {i: set() for i in range(len(stored))}
    for r in U.repeated_spans(docs).collect():
        i = numbers.index(r[U.ROW])
        spans = [m.span() for m in re.finditer(r"\S+", stored[i][1])]
        found = {w for w, (a, b) in enumerate(spans) if r.start <= a and b <= r.end}
        assert len(found) == r.n_words and not any(a < r.start < b or a < r.end < b for a, b in spans)
        got[i] |= found
    assert got == brute_words(stored, U.MIN_RUN_WORDS) and sum(map(len, got.values())) > 1500


def test_units_end_as_the_pattern_says():
    """Offsets and words of units, cut for many texts at once, against a regular expression on each text."""
    unit = re.compile(r"[^\n]+?(?:[.!?…。！？][\"')\]”’»]*(?=\s)|(?=\n|\Z))")
    rng = random.Random(5)
    marks = ["a", "Σ", "İ", ".", "!", "。", '"', ")", "»", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", " ", "　", "😀", "b.c"]
    texts = ["", ".", ". ", "! a", '." a', "!! a", "\n. a.\n", *[t or "" for t in ODD_TEXTS]]
    texts += ["".join(rng.choices(marks, k=rng.randrange(40))) for _ in range(3000)]
    words = U.Words(texts)
    got = {}
    for first, n, a, b, h in zip(words.first, words.count, words.unit_start, words.unit_end, words.unit_hash, strict=True):
        got.setdefault(words.doc[first], []).append((words.word[first], n, a, b, h))
    seen = {}
    for i, text in enumerate(texts):
        at, want = 0, []
        for m in unit.finditer(text):
            said = tuple(m[0].lower().split())
            if said:
                want.append((at, len(said), m.start(), m.end(), said))
                at += len(said)
        assert [g[:4] for g in got.get(i, [])] == [w[:4] for w in want], text
        assert all(seen.setdefault(w[4], g[4]) == g[4] for g, w in zip(got.get(i, []), want, strict=True))
        spans = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        assert spans == [(a, b) for a, b in zip(words.start[words.doc == i], words.end[words.doc == i], strict=True)]
    assert len(set(seen.values())) == len(seen)


def test_what_occurs_once_is_never_written(spark, make_docs, tmp_path):
    """Before, each sentence and each periodic window was a row of a table."""
    shared = os.path.join(spark.conf.get("spark.checkpoint.dir"), "corpusengine")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    texts = [f"Text {i} says this {i}. It also says that {i}! " + " ".join(f"v{i}w{j}" for j in range(60)) for i in range(100)]
    assert U.repeated_spans(make_docs([*texts, "x y " * 300], tmp_path)).count() == 0
    written = [spark.read.parquet(os.path.join(shared, d)).count() for d in set(os.listdir(shared)) - before]
    assert sum(written) <= 2


def test_hashes_dealt_to_many_tasks_keep_one_first(monkeypatch, make_docs, tmp_path):
    """With every repeated hash hot, the spans are the same as with none, in the order of ids, nulls last."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(80):
        a = rng.randrange(20)
        own = [f"t{i}w{j}" for j in range(rng.randrange(5, 40))]
        texts.append(" ".join([*own, *passage[a : a + rng.randrange(26, 40)], ".", *own[:3]]) + f"\nThe same. {P}" * (i % 3))
    texts += ["a b c " * 40, "z " + "a b c " * 50, " ".join(passage + passage)]
    ids = [None if i % 17 == 0 else (i * 7) % 50 for i in range(len(texts))]
    docs = make_docs(texts, tmp_path, ids)
    cold = sorted(map(str, U.repeated_spans(docs).collect()))
    monkeypatch.setattr(U, "HOT_ROWS", 2)
    monkeypatch.setattr(U, "HOT_SHARE", 10**9)
    assert sorted(map(str, U.repeated_spans(docs).collect())) == cold and len(cold) > 50


def test_of_a_hot_group_only_the_first_of_each_task_is_compared(monkeypatch, make_docs, tmp_path):
    """Before, each piece of a hot hash was joined to the first one: all 4,000 sentences here and each window."""
    passage = " ".join(f"p{i}" for i in range(60))
    texts = ["Said over again.\n" * 100 + f"own{i} {passage} tail{i}" for i in range(40)]
    docs = make_docs(texts, tmp_path, [None, *range(139, 100, -1)])
    cold = sorted(map(str, U.repeated_spans(docs).collect()))
    seen, write = {}, U.materialize
    monkeypatch.setattr(U, "materialize", lambda df, label: seen.setdefault(label, write(df, label)))
    monkeypatch.setattr(U, "HOT_ROWS", 2)
    monkeypatch.setattr(U, "HOT_SHARE", 10**9)
    monkeypatch.setattr(U, "SALTS", 3)
    spans = U.repeated_spans(docs)
    assert sorted(map(str, spans.collect())) == cold and {r.kept_doc_id for r in spans.collect()} == {101}
    keys = seen["first-pieces"].count()
    assert seen["found-pieces"].where("key IS NOT NULL").count() > 4000 > 3 * keys
    assert seen["found-pieces"].where("kept_row IS NOT NULL").count() <= 3 * keys
