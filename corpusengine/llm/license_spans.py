"""Licence passages found by a generalised suffix automaton of licence tokens.

The automaton of all templates is built once on the driver; its size is that of the
templates.  Each text is streamed through it word by word: the state gives the longest
template substring that ends at the word, and through its suffix links the longest one of
each template.  A match is emitted for a template where that template's own length stops
growing, so what several templates share counts for all of them.  Long matches of a
template, with all places they have in it, are chained in its order over gaps; the chain
that covers most is a span.  Of spans inside each other the one that covers more words,
or as many and more of its template, gives the label: a notice of the Lesser licence is none
of the general one.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusengine.llm.common import col, text_of

#: The base phrases, and public licence notices as templates `(label, text)`.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
     "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
     "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
     "including commercial applications, and to alter it and redistribute it freely"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
     "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
     "non-commercial, and by any means."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
     "License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
     "License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("all-rights-reserved", "All rights reserved."),
]
#: Names by which a notice refers to a licence, after "under the"; versions are told apart by the longer name.
NAMES = [
    ("mit", "MIT License"),
    ("apache-2", "Apache License 2.0"),
    ("apache-2", "Apache License, Version 2.0"),
    ("apache-2", "Apache 2.0 License"),
    ("bsd-2-clause", "BSD 2-Clause License"),
    ("bsd-3-clause", "BSD 3-Clause License"),
    ("isc", "ISC License"),
    ("gpl", "GNU General Public License"),
    ("gpl-2", "GNU General Public License, version 2"),
    ("gpl-3", "GNU General Public License, version 3"),
    ("gpl-2", "GNU GPL v2"),
    ("gpl-3", "GNU GPL v3"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("gfdl", "GNU Free Documentation License"),
    ("mpl-1.1", "Mozilla Public License, version 1.1"),
    ("mpl-2", "Mozilla Public License 2.0"),
    ("mpl-2", "Mozilla Public License, v. 2.0"),
    ("mpl-2", "Mozilla Public License, version 2.0"),
    ("epl-2", "Eclipse Public License 2.0"),
    ("bsl-1", "Boost Software License, Version 1.0"),
]
#: SPDX identifiers, each with its label.
SPDX = [
    ("mit", "MIT"), ("apache-2", "Apache-2.0"), ("bsd-2-clause", "BSD-2-Clause"), ("bsd-3-clause", "BSD-3-Clause"), ("isc", "ISC"),
    ("gpl-2", "GPL-2.0"), ("gpl-3", "GPL-3.0"), ("lgpl", "LGPL-2.1"), ("lgpl", "LGPL-3.0"), ("agpl", "AGPL-3.0"), ("mpl-2", "MPL-2.0"),
    ("epl-2", "EPL-2.0"), ("bsl-1", "BSL-1.0"), ("zlib", "Zlib"), ("unlicense", "Unlicense"), ("cc0", "CC0-1.0"),
    ("cc-by", "CC-BY-4.0"), ("cc-by-sa", "CC-BY-SA-4.0"), ("cc-by-nc", "CC-BY-NC-4.0"), ("cc-by-nc-sa", "CC-BY-NC-SA-4.0"),
]
TEMPLATES += [(label, f"under the {name}") for label, name in NAMES]
TEMPLATES += [(label, f"SPDX-License-Identifier: {name}") for label, name in SPDX]
#: A match shorter than this, and than its template, starts no span.
MIN_MATCH = 4
#: Words that may lie between two matches of a span.
MAX_GAP = 12
#: Share of the template that a span must cover to give its label.
MIN_COVERAGE = 0.75

#: Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z is lower-cased; all other bytes are gaps.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORD_BYTES).split()


@dataclass
class State:
    length: int
    link: int = -1
    after: dict[int, int] = field(default_factory=dict)
    #: All positions in each template in which a longest string of this state ends.
    ends: dict[int, set[int]] = field(default_factory=dict)


@dataclass(frozen=True)
class Span:
    template: int
    first: int
    last: int
    covered: int


class Automaton:
    """Suffix automaton of the templates' and phrases' words; phrases are templates of their own."""

    def __init__(self, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]):
        self.labels = [label for label, _ in phrases + templates]
        self.n_phrases = len(phrases)
        self.vocabulary: dict[bytes, int] = {}
        self.texts = [
            [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text.encode())]
            for _, text in phrases + templates
        ]
        self.states = [State(0)]
        for t, text in enumerate(self.texts):
            last = 0
            for i, word in enumerate(text):
                last = self._extend(last, word)
                self.states[last].ends.setdefault(t, set()).add(i)
        for v in sorted(range(1, len(self.states)), key=lambda v: -self.states[v].length):
            if self.states[v].link:  # The empty string ends everywhere and is never asked for.
                link = self.states[self.states[v].link]
                for t, at in self.states[v].ends.items():
                    link.ends.setdefault(t, set()).update(at)
        self._whole = [self._phrases_ending(v) for v in range(len(self.states))]
        self.need = [min(MIN_MATCH, len(text)) for text in self.texts]
        self.least = min(self.need[self.n_phrases :], default=MIN_MATCH)
        self._held = [self._templates_of(v) for v in range(len(self.states))]

    def _extend(self, last: int, word: int) -> int:
        states = self.states
        known = states[last].after.get(word)
        if known is not None and states[known].length == states[last].length + 1:
            return known
        if known is not None:
            return self._clone(last, word, known)
        new = len(states)
        states.append(State(states[last].length + 1))
        v = last
        while v != -1 and word not in states[v].after:
            states[v].after[word] = new
            v = states[v].link
        if v == -1:
            states[new].link = 0
        else:
            target = states[v].after[word]
            states[new].link = target if states[target].length == states[v].length + 1 else self._clone(v, word, target)
        return new

    def _clone(self, v: int, word: int, target: int) -> int:
        states = self.states
        new, old = len(states), states[target]
        states.append(State(states[v].length + 1, old.link, dict(old.after)))
        while v != -1 and states[v].after.get(word) == target:
            states[v].after[word] = new
            v = states[v].link
        old.link = new
        return new

    def _phrases_ending(self, v: int) -> list[int]:
        """Phrases that are suffixes of the strings of a state, each with its words."""
        found = []
        while v > 0:
            state = self.states[v]
            found += [
                p for p in range(self.n_phrases)
                if len(self.texts[p]) - 1 in state.ends.get(p, ())
                and self.states[state.link].length < len(self.texts[p]) <= state.length
            ]
            v = state.link
        return found

    def _templates_of(self, v: int) -> list[tuple[int, int, int]]:
        """`(template, state, length)` of each template that holds a long enough suffix of a state's strings.

        The state is the deepest one that holds the template, the length that of its longest string.
        """
        found: dict[int, tuple[int, int]] = {}
        while v > 0 and self.states[v].length >= self.least:
            for t in self.states[v].ends:
                if t >= self.n_phrases and self.states[v].length >= self.need[t]:
                    found.setdefault(t, (v, self.states[v].length))
            v = self.states[v].link
        return [(t, u, n) for t, (u, n) in found.items()]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Phrase places `(start, phrase)`, and maximal matches `(end, length, template, state)` of each template."""
        states, whole, number, held, need = self.states, self._whole, self.vocabulary.get, self._held, self.need
        places, matches = [], []
        v = length = 0
        before = -2
        live: dict[int, tuple[int, int]] = {}  # template: length of its match that ends at `before`, state
        for at, word in [(i, w) for i, w in enumerate(map(number, words)) if w is not None]:
            if at != before + 1:
                v = length = 0
                matches += [(before, n, t, u) for t, (n, u) in live.items()]
                live = {}
            while v and word not in states[v].after:
                v = states[v].link
                length = states[v].length
            if word in states[v].after:
                v = states[v].after[word]
                length += 1
            if whole[v]:
                places += [(at - len(self.texts[p]) + 1, p) for p in whole[v] if len(self.texts[p]) <= length]
            if live or length >= self.least:
                now = {t: (min(n, length), u) for t, u, n in held[v] if length >= need[t]}
                matches += [(before, n, t, u) for t, (n, u) in live.items() if t not in now or now[t][0] != n + 1]
                live = now
            before = at
        matches += [(before, n, t, u) for t, (n, u) in live.items()]
        return places, matches

    def spans(self, matches: list[tuple[int, int, int, int]]) -> list[Span]:
        """The spans of all templates, without those inside a span that covers more words."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for end, length, t, v in matches:
            by_template.setdefault(t, []).append((end, length, v))
        found = [s for t, own in by_template.items() for s in self._chains(t, own)]
        return self._outermost(found)

    def _chains(self, t: int, matches: list[tuple[int, int, int]]) -> list[Span]:
        """Chains of one template's matches, in its order and in the text's, over gaps of `MAX_GAP` words.

        Every place of a match in the template is a link of its own; each takes the predecessor
        that covers most.  Only matches that end within `MAX_GAP` words of its start can be
        one, and ends grow, so a long text costs no more per match than a short one.
        """
        links: list[tuple[int, int, int, int]] = []  # last word, first word of the chain, place in the template, covered
        low = 0
        for end, length, v in matches:
            first = end - length + 1
            while low < len(links) and first - links[low][0] > MAX_GAP:
                low += 1
            before = links[low:]
            for place in sorted(self.states[v].ends[t]):
                best = (length, first)
                for last, begun, t_last, covered in before:
                    skip = max(0, last + 1 - first, t_last - place + length)
                    if skip < length:
                        best = max(best, (covered + length - skip, begun))
                links.append((end, best[1], place, best[0]))
        out: list[Span] = []
        whole = MIN_COVERAGE * len(self.texts[t])
        firsts: list[int] = []
        for last, first, _, covered in sorted(links, key=lambda x: (-x[3], x[0] - x[1], x[0])):
            if covered < whole:
                break
            # Spans of one template do not overlap: the one that covers most comes first.
            i = bisect.bisect_right(firsts, last)
            if i and out[i - 1].last >= first:
                continue
            firsts.insert(i, first)
            out.insert(i, Span(t, first, last, covered))
        return out

    def _outermost(self, spans: list[Span]) -> list[Span]:
        """Spans without those inside a span of more covered words, or of as many and a greater share of its template."""
        def weight(s: Span) -> tuple[int, int]:
            return s.covered, -len(self.texts[s.template])

        kept: list[Span] = []
        reaching: list[Span] = []
        for s in sorted(spans, key=lambda s: (s.first, -s.last, -s.covered, len(self.texts[s.template]), s.template)):
            reaching = [o for o in reaching if o.last >= s.first]
            if not any(o.last >= s.last and weight(o) > weight(s) for o in reaching):
                kept.append(s)
            reaching.append(s)
        return kept


SPAN_KIND = "array<struct<label:string,first:long,last:long,coverage:double>>"
KINDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    f"spans {SPAN_KIND}"
)


def license_spans(
    docs: DataFrame, text: str = "text", phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES
) -> DataFrame:
    """`doc_id`, counts, labels, score and covered spans of every row.

    `n_base` counts all places of the phrases, `first_word` and `last_word` are the least and
    largest of their first words (null without any).  `labels` adds the labels of spans to
    those of phrases; `score` is the largest covered share, 1 for a phrase, 0 without both.
    A null text counts as empty.  Rows are independent, whatever else they hold; one pass
    without a shuffle.
    """
    built = docs.sparkSession.sparkContext.broadcast(Automaton(phrases, templates))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = built.value
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                words = words_of(value.as_py())
                places, matches = machine.scan(words)
                spans = sorted(machine.spans(matches), key=lambda s: (s.first, s.last, s.template))
                base = {machine.labels[p] for _, p in places}
                shares = [s.covered / len(machine.texts[s.template]) for s in spans]
                starts = [at for at, _ in places]
                rows.append(
                    {
                        "n_words": len(words),
                        "n_base": len(places),
                        "first_word": min(starts, default=None),
                        "last_word": max(starts, default=None),
                        "base_labels": ",".join(sorted(base)),
                        "labels": ",".join(sorted(base | {machine.labels[s.template] for s in spans})),
                        "score": max([1.0 if places else 0.0, *shares]),
                        "spans": [
                            {"label": machine.labels[s.template], "first": s.first, "last": s.last, "coverage": c}
                            for s, c in zip(spans, shares, strict=True)
                        ],
                    }
                )
            table = pa.Table.from_pylist(rows, ARROW)
            yield from table.add_column(0, "doc_id", batch.column("doc_id")).to_batches()

    rows = docs.select(col("doc_id"), text_of(text).cast("binary").alias("text"))
    return rows.mapInArrow(find, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {KINDS}")


ARROW = pa.schema(
    [
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([
            ("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64()),
        ]))),
    ]
)
