import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusengine.llm import phrases
from tests.llm.conftest import ODD_TEXTS


def normal(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def plain(rows, top, least=10, overlap=50):
    """The contract, word for word."""
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", normal(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, n in f.items():
        total = sum(c for g, c in n.items() if len(g) == 1)
        found = []
        for g, a in n.items():
            if len(g) > 1 and a >= least:
                score, _, l, r = min((1_000_000 * a * a // (n[g[:k]] * n[g[k:]]), k, n[g[:k]], n[g[k:]]) for k in range(1, len(g)))
                longer = [b for h, b in n.items() if len(h) == 3 and len(g) == 2 and g in (h[:2], h[1:]) and b >= least]
                if not any(100 * b >= overlap * a for b in longer):
                    found.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (s, a, g, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, g.decode(), -a, l, r, total, -s))
    return sorted(out)


def corpus(seed=3, n=400):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    fixed = ["New York City", "new york", "ad hoc", "in vitro test", "É é", "a a a a"]
    rows = []
    for i in range(n):
        text = []
        for _ in range(30):
            text.append(draw.choice(fixed) if draw.random() < 0.2 else words[min(int(draw.expovariate(0.08)), 59)])
            if draw.random() < 0.1:
                text.append(draw.choice([".", ", ", "\n", "\t", "!?", "\x0b"]))
        rows.append((["en", "de", None, "x\ny"][i % 4 if i % 7 else 0], " ".join(text)))
    return rows + [("en", t) for t in ODD_TEXTS]


def table(spark, rows, parts=3):
    kinds = "lang string, text string, n long, phrase string, `a.b` int"
    return spark.createDataFrame([(*r, 1, "p", 2) for r in rows], kinds).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.mark.parametrize("settings", [{"top": 2000}, {"top": 5, "first": 1}, {"top": 30, "first": 1, "most_bits": 64}])
def test_against_plain_counts(spark, rows, settings):
    got = phrases.collocations(table(spark, rows), **settings)
    assert sorted(map(tuple, got.collect())) == plain(rows, settings["top"])
    assert dict(got.dtypes) == {c: "string" if c in ("lang", "phrase") else "bigint" for c in got.columns if c != "rank"} | {"rank": "bigint"}


def test_counts_do_not_depend_on_blocks_and_flushes(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "blocks", lambda text, f=phrases.blocks: f(text, 7))
    monkeypatch.setattr(phrases, "WORDS", 40)
    monkeypatch.setattr(phrases, "PHRASES", 50)
    source = [(lang or "und", normal(t).encode()) for lang, t in rows]
    one = Counter()
    for batch in phrases._count_words(iter(source)):
        for lang, g, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            one[lang, g] += n
    everything = phrases.BitMap(np.full(1, 2**64 - 1, np.uint64), 63)
    for size in (2, 3):
        many, want = Counter(), Counter()
        for batch in phrases._counting(size, everything, lambda *h: np.ones(len(h[0]), bool))(iter(source)):
            for lang, g, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                many[lang, g] += n
        for lang, t in source:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", t.decode()):
                w = re.findall(r"[^\x20\x09]+", piece)
                want.update((lang, " ".join(w[i : i + size])) for i in range(len(w) - size + 1))
                if size == 2:
                    one.subtract((lang, x) for x in w)
        assert many == want
    assert not any(n for (_, g), n in one.items() if g)


def test_maps_hold_what_was_put_in_and_hash_as_spark_does(spark):
    pairs = spark.range(5000).select(F.lit("l").alias("lang"), F.concat(F.lit("é"), "id").alias("x"), F.concat(F.lit("y"), "id").alias("y"))
    keyed = pairs.select("x", "y", phrases.word_key(F.col("lang"), F.col("x")).alias("hx"), phrases.word_key(F.col("lang"), F.col("y")).alias("hy"), phrases.pair_key(F.col("lang"), F.col("x"), F.col("y")).alias("key"))
    held = phrases.bit_map(keyed.select("key"))
    got = keyed.toPandas()
    own = phrases.pair_hashes(got.hx.to_numpy().view(np.uint64), got.hy.to_numpy().view(np.uint64))
    assert (own == got.key.to_numpy().view(np.uint64)).all() and held.holds(own).all()
    assert all(int(k) in held for k in own[:50])
    others = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    assert held.holds(others).mean() < 0.05


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    rows = spark.createDataFrame([(big, big + 1, big + 2)], "a long, l long, r long")
    assert rows.select(phrases._score("a", "l", "r")).first()[0] == 1_000_000 * big * big // ((big + 1) * (big + 2))


def test_empty_table_and_nulls(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, ""), ("en", None)], "lang string, text string")
    assert phrases.collocations(nulls).count() == 0
