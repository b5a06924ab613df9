import math
import random
from collections import Counter, defaultdict

from corpusengine.llm import mixing as M
from tests.llm.conftest import ODD_TEXTS


def table(make_docs, tmp_path, n=600):
    rng = random.Random(1)
    texts = [" ".join(["w"] * rng.randint(1, 60)) for _ in range(n)]
    sources = [rng.choice(["big"] * 12 + ["mid"] * 4 + ["small", None]) for _ in range(n)]
    docs = make_docs(texts, tmp_path)
    spark = docs.sparkSession
    rows = list(zip(range(n), texts, sources, strict=True))
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "mix.parquet"))
    return spark.read.parquet(str(tmp_path / "mix.parquet")), rows


def brute_alpha(tokens, max_repeats, max_entropy=None):
    total = sum(tokens)
    for step in range(10**4 + 1):
        a = step / 10**4
        p = [(t / total) ** a for t in tokens]
        z = sum(p)
        r = [t ** (a - 1) for t in tokens]
        entropy = -sum(x / z * math.log(x / z) for x in p)
        if max(r) / min(r) <= max_repeats + 1e-12 and (max_entropy is None or entropy <= max_entropy):
            return a
    return 1.0


def test_exponent_and_draw_against_brute_force(make_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 40)
    docs, rows = table(make_docs, tmp_path)
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len(t.split())
    sources = docs.sparkSession.createDataFrame([(s, t) for s, t in tokens.items()], "source string, tokens long")
    for repeats, entropy in ((2.0, None), (3.0, 0.9), (50.0, None), (1.0, None)):
        assert abs(M.exponent(sources, repeats, entropy) - brute_alpha(tokens.values(), repeats, entropy)) < 2e-4
    alpha = M.exponent(sources, 2.0)
    scale = max(t ** (1 - alpha) for t in tokens.values())
    got = M.drawn(docs).collect()
    assert sorted(r.doc_id for r in got) == [i for i, _, _ in rows]
    groups = defaultdict(list)
    for r in got:
        groups[r.source].append(r)
    for s, own in groups.items():
        quota = math.floor(round(tokens[s] ** alpha * scale, 3))
        left = quota % tokens[s]
        for r in sorted(own, key=lambda r: r.place):
            left -= r.tokens
            assert r.copies == quota // tokens[s] + (left >= 0)
        used = sum(r.copies * r.tokens for r in own)
        assert quota - 60 <= used <= quota and min(r.copies for r in own) >= 1 and max(r.copies for r in own) <= 3
    copies = {r.doc_id: r.copies for r in got}
    assert Counter(r.doc_id for r in M.mixed(docs).collect()) == copies


def test_budget(make_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 40)
    docs, _ = table(make_docs, tmp_path)
    got = M.drawn(docs, budget=5_000).collect()
    used = sum(r.copies * r.tokens for r in got)
    assert 5_000 - 4 * 61 <= used <= 5_000


def test_odd_rows(make_docs, tmp_path):
    docs = make_docs(ODD_TEXTS, tmp_path, [1] * len(ODD_TEXTS))
    assert M.mixed(docs).count() == len(ODD_TEXTS) and M.mixed(docs).columns == docs.columns
    empty = make_docs([], tmp_path)
    assert M.drawn(empty).count() == 0 and M.mixed(empty).count() == 0
