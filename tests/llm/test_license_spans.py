import random
import re

from corpusengine.llm import license_spans as L
from tests.llm.conftest import ODD_TEXTS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_places(w):
    return sorted(
        (i, p) for p, (_, phrase) in enumerate(L.PHRASES) for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()
    )


def brute_matching(w, t):
    """Longest substring of a template that ends at each word, by trying all."""
    subs = {tuple(t[i:j]) for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    out = []
    for e in range(len(w)):
        n = 0
        while n <= e and tuple(w[e - n : e + 1]) in subs:
            n += 1
        out.append(n)
    return out


def brute_tops(w, t):
    """`(end, length)` of a template's maximal matches that are long enough."""
    best, need = brute_matching(w, t), min(L.MIN_MATCH, len(t))
    return {(e, n) for e, n in enumerate(best) if n >= need and (e + 1 == len(w) or best[e + 1] != n + 1)}


def brute_cover(w, t):
    """Most words of a template that any chain of its matches covers, by trying all chains."""
    tops = sorted(brute_tops(w, t))
    links = [(e, n, i + n - 1) for e, n in tops for i in range(len(t) - n + 1) if t[i : i + n] == w[e - n + 1 : e + 1]]

    def grown(chain_end, t_end, covered, rest):
        best = covered
        for k, (e, n, i) in enumerate(rest):
            skip = max(0, chain_end + 1 - (e - n + 1), t_end + 1 - (i - n + 1))
            if e > chain_end and e - n + 1 - chain_end <= L.MAX_GAP and skip < n:
                best = max(best, grown(e, i, covered + n - skip, rest[k + 1 :]))
        return best

    return max((grown(e, i, n, links[k + 1 :]) for k, (e, n, i) in enumerate(links)), default=0)


def test_scan_against_brute_force():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(6)]
    machine = L.Automaton([("p", "a b"), ("q", "a a")], [("t", t) for t in texts])
    plain = [t.split() for t in ["a b", "a a", *texts]]
    for _ in range(400):
        w = [rng.choice("abcx") for _ in range(rng.randint(0, 20))]
        places, matches = machine.scan([x.encode() for x in w])
        assert sorted(places) == sorted(
            (i, p) for p in (0, 1) for i in range(len(w)) if w[i : i + 2] == plain[p]
        )
        for t in range(2, len(plain)):
            assert sorted((e, n) for e, n, k, _ in matches if k == t) == sorted(brute_tops(w, plain[t]))
        for e, n, t, v in matches:
            m = w[e - n + 1 : e + 1]
            ends = {i + n - 1 for i in range(len(plain[t]) - n + 1) if plain[t][i : i + n] == m}
            assert machine.states[v].ends[t] == ends


def test_chains_against_brute_force(monkeypatch):
    monkeypatch.setattr(L, "MIN_MATCH", 2)
    monkeypatch.setattr(L, "MAX_GAP", 3)
    rng = random.Random(5)
    seen = 0
    for _ in range(250):
        t = [rng.choice("abcd") for _ in range(rng.randint(4, 9))]
        w = [x for x in t if rng.random() < 0.85 for x in ([x] if rng.random() < 0.8 else [x, rng.choice("abcdx")])]
        machine = L.Automaton([], [("t", " ".join(t))])
        _, matches = machine.scan([x.encode() for x in w])
        spans, best = machine.spans(matches), brute_cover(w, t)
        assert max((s.covered for s in spans), default=0) == (best if best >= L.MIN_COVERAGE * len(t) else 0)
        assert all(a.last < b.first for a, b in zip(spans, spans[1:]))
        seen += bool(spans)
    assert seen > 50


def labels(text):
    machine = L.Automaton(L.PHRASES, L.TEMPLATES)
    return {machine.labels[s.template] for s in machine.spans(machine.scan(L.words_of(text.encode()))[1])}


def test_notices_that_share_words():
    cc = "This work is licensed under a Creative Commons Attribution"
    cases = {
        f"{cc}-NonCommercial-ShareAlike 4.0 International License": {"cc-by-nc-sa"},
        f"{cc}-NonCommercial 4.0 International License": {"cc-by-nc"},
        f"{cc} 4.0 International License": {"cc-by"},
        "This work is licensed under the Mozilla Public License, v. 2.0": {"mpl-2"},
        "Covered under the Mozilla Public License, version 1.1, as it stands": {"mpl-1.1"},
        "Licensed under the BSD 3-Clause License": {"bsd-3-clause"},
        "Distributed under the ISC license": {"isc"},
        "// SPDX-License-Identifier: Apache-2.0": {"apache-2"},
        "# SPDX-License-Identifier: GPL-2.0-or-later": {"gpl-2"},
        "SPDX-License-Identifier: FooBar-1.0": set(),
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation": {"agpl"},
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation": {"lgpl"},
        "under the MIT License or, at your option, later in this file and far from it, under the Apache License, Version 2.0": {"mit", "apache-2"},
        "the terms and conditions under which the library was built are public": set(),
    }
    assert {text: labels(text) for text in cases} == cases


def test_long_text_of_one_notice():
    machine = L.Automaton(L.PHRASES, L.TEMPLATES)
    spans = machine.spans(machine.scan(L.words_of(b"All rights reserved. " * 20_000))[1])
    assert len(spans) == 20_000 and all(s.covered == 3 for s in spans)


def test_labels_and_spans(make_docs, tmp_path):
    texts = [
        *ODD_TEXTS,
        "x Released UNDER the mit-license. under the MIT license",
        "This work is licensed under the GNU General Public License, version 3.",
        "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met: a",
        "the of and by under license",
        "Licensed under CC BY-NC 4.0.",
    ]
    docs = make_docs(texts, tmp_path)
    got = {r.doc_id: r for r in L.license_spans(docs).collect()}
    for i, text in enumerate(texts):
        w, r = words(text), got[i]
        places = brute_places(w)
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert r.first_word == min((p for p, _ in places), default=None) and r.last_word == max((p for p, _ in places), default=None)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    n = len(ODD_TEXTS)
    assert [got[n + k].labels for k in range(5)] == ["mit", "gpl-3", "bsd", "", "cc-by-nc"]
    assert got[n + 2].base_labels == "" and [(s.first, s.last) for s in got[n + 2].spans] == [(0, 21)]
    assert all(got[i].labels == "" and got[i].score == 0 for i in range(n))
    assert L.license_spans(make_docs([], tmp_path)).count() == 0
