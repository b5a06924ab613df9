import hashlib
from collections import defaultdict

import pytest

from corpusengine.llm import exact_dedup
from corpusengine.llm.common import ROW
from tests.llm.conftest import ODD_TEXTS


def normal(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def plain(texts, ids):
    """Rows `(doc_id, keep_id, size, sha)` and how many rows of each stay."""
    groups = defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        groups[normal(t)].append(i)
    order = lambda i: (i is not None, i or 0)
    return sorted(
        ((i, max(g, key=order), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g), key=str
    ), len(groups)


HOT = ["Hot TEXT"] * 150 + ["hot text"] * 150
TEXTS = [*HOT, *ODD_TEXTS, "É", "é", *[f"only {i}" for i in range(300)], *["twice a"] * 2, *["Twice b", "twice B", "TWICE B"]]
IDS = [*range(400), None, None, *[77] * 20]
IDS = [*IDS, *range(1000, 1000 + len(TEXTS) - len(IDS))]


@pytest.mark.parametrize("share", [1 / 1000, 0.2, 2.0])
def test_against_plain_groups(make_docs, tmp_path, share):
    docs = make_docs(TEXTS, tmp_path, IDS).repartition(7)
    got = exact_dedup.classes(docs, share=share).collect()
    want, groups = plain(TEXTS, IDS)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert len({r[ROW] for r in got}) == len(TEXTS)
    stays = [r for r in got if r.kept]
    assert len(stays) == len({r.text_sha256 for r in stays}) == groups
    assert all(r.doc_id == r.keep_id for r in stays)


def test_frequent_digests_are_split_off(make_docs, tmp_path):
    rows = exact_dedup.digests(make_docs(TEXTS, tmp_path, IDS))
    heavy = exact_dedup.frequent_groups(rows, share=0.2, tracked=64).collect()
    assert [(r.group_size, r.stays.doc_id) for r in heavy] == [(300, 299)]
    plan = exact_dedup.classes(make_docs(TEXTS, tmp_path, IDS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_whole_rows_stay(make_docs, tmp_path):
    docs = make_docs(TEXTS, tmp_path, IDS)
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    want, groups = plain(TEXTS, IDS)
    assert len(rows) == groups
    assert sorted((normal(r.text), r.doc_id) for r in rows if r.doc_id is not None) == sorted(
        {(normal(t), k) for t in TEXTS for _, k, _, sha in want if k is not None and hashlib.sha256(normal(t).encode()).hexdigest() == sha}
    )


def test_empty_table_and_all_null(make_docs, tmp_path):
    assert exact_dedup.report(make_docs([], tmp_path)).count() == 0
    assert exact_dedup.deduplicated(make_docs([], tmp_path)).count() == 0
    rows = exact_dedup.report(make_docs([None, None, ""], tmp_path, [None, None, None])).collect()
    assert [r.group_size for r in rows] == [3, 3, 3] and sum(r.kept for r in rows) == 1
