import time

import pytest

from corpusengine.operators import hybrid, inference
from corpusengine.operators.inference import Breaker, _accepted, refuse_no_json_map, refuse_no_list
from tests.conftest import rows


def ask(model, inputs, accept=lambda a: None if a else "empty", batch_size=4, retries=2, give_up=5):
    calls = []

    def counted(batch):
        calls.append(list(batch))
        return model(batch)

    return _accepted(counted, inputs, accept, batch_size, retries, 0.0, None, Breaker(give_up)), calls


def test_only_refused_inputs_are_asked_again():
    seen = {}

    def model(batch):
        out = []
        for x in batch:
            seen[x] = seen.get(x, 0) + 1
            out.append("" if x in ("b", "d") and seen[x] < 2 or x == "e" else x.upper())
        return out

    got, calls = ask(model, list("abcdef"))
    assert got == [("A", None, 1), ("B", None, 2), ("C", None, 1), ("D", None, 2), (None, "empty", 3), ("F", None, 1)]
    assert calls == [list("abcd"), list("ef"), list("bde"), ["e"]]


def test_one_bad_input_spoils_no_other():
    def model(batch):
        if "bad" in batch:
            raise RuntimeError("no")
        return [x * 2 for x in batch]

    got, calls = ask(model, ["a", "bad", "b", "c", "d"])
    assert [g[0] for g in got] == ["aa", None, "bb", "cc", "dd"] and got[1][1] == "RuntimeError: no" and got[1][2] == 3
    assert calls[:2] == [["a", "bad", "b", "c"], ["d"]] and ["bad"] in calls


def test_a_dead_model_is_given_up():
    def model(batch):
        raise RuntimeError("down")

    got, calls = ask(model, [str(i) for i in range(100)], batch_size=1, give_up=5)
    assert len(calls) == 5 and all(g[0] is None for g in got)
    assert got[99] == (None, "model given up after 5 failed calls", 0) and got[0][1] == "RuntimeError: down"


def test_the_breaker_counts_failures_in_a_row():
    breaker = Breaker(2)
    for error in ("x", None, "x"):
        breaker.report(error)
    assert not breaker.open
    breaker.report("x")
    assert breaker.open


def test_back_off_grows(monkeypatch):
    slept = []
    monkeypatch.setattr(time, "sleep", slept.append)
    _accepted(lambda b: [""] * len(b), ["a"], lambda a: "empty", 1, 3, 2.0, None, Breaker(9))
    assert slept == [2.0, 4.0, 8.0]


@pytest.mark.parametrize(
    ("answer", "good"),
    [('{"a": ["x"]}', True), ('```json\n{"a": []}\n```', True), ("{}", False), ("", False), (None, False), ("[1]", False), ('{"a"', False)],
)
def test_json_maps(answer, good):
    assert (refuse_no_json_map(answer) is None) == good


@pytest.mark.parametrize(("answer", "good"), [('Sure: ["A", "B"] ok', True), ("[]", False), ("none", False), ("[1]", False), (None, False)])
def test_lists(answer, good):
    assert (refuse_no_list(answer) is None) == good


def test_apply_accepted_adds_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "id long, text string").coalesce(1)
    got = inference.apply_accepted(df, "text", lambda b: [x.upper() for x in b], lambda a: None if a else "empty", retries=1, backoff=0.0)
    assert rows(got, "id", "answer", "error", "attempts") == [(1, "A", None, 1), (2, None, None, 0), (3, None, "empty", 2)]
    assert inference.apply_accepted(df.limit(0), "text", lambda b: b, lambda a: None).count() == 0


def test_pairs_at_fault_get_no_score_and_their_query_keeps_its_order(spark):
    def load():
        def model(queries, texts):
            if "poison" in texts:
                raise ValueError("bad pair")
            return [float(len(t)) for t in texts]

        return model

    pairs = spark.createDataFrame(
        [(1, "q", i, "x" * i) for i in range(7)] + [(2, "q", i, t) for i, t in enumerate(["a", "poison", "bbb", "cc"])] + [(3, None, 0, None)],
        "query_id long, query string, position int, text string",
    )
    scored = hybrid.score_pairs(pairs, load, batch_size=3)
    assert rows(scored.where("rerank_score IS NULL"), "query_id", "position") == [(2, 1)]
    got = hybrid.rerank_model(pairs, load, 3, batch_size=3)
    assert rows(got, "query_id", "rank", "position", "rerank_score", "scored") == [
        (1, 1, 6, 6.0, True), (1, 2, 5, 5.0, True), (1, 3, 4, 4.0, True),
        (2, 1, 0, None, False), (2, 2, 1, None, False), (2, 3, 2, None, False), (3, 1, 0, 0.0, True),
    ]
    assert hybrid.rerank_model(pairs.limit(0), load, 3).count() == 0


def test_named_sections(spark):
    sections = spark.createDataFrame([("Car Loan",), ("Home Loan",), ("car loan!",), ("Zebra Care",)], "section string")
    queries = spark.createDataFrame([(i, "zebra care") for i in range(1, 7)], "query_id long, query string")
    named = spark.createDataFrame(
        [(1, ["CAR  loan"]), (2, ["nothing known", "Zebra"]), (3, ["zebra care", "zebra care", "home loan"]), (4, []), (5, None)],
        "query_id long, names array<string>",
    )
    got = dict(rows(hybrid.route_named(queries, named, sections, threshold=0.55)))
    # `home loan` shares one word of two with `car loan`: 0.5, below the threshold.
    assert got == {
        1: ["car loan"], 2: ["car loan", "home loan"], 3: ["zebra care", "home loan"], 4: ["zebra care"], 5: ["zebra care"], 6: ["zebra care"],
    }
    assert rows(hybrid.route_named(queries.limit(1), named, sections.limit(0))) == [(1, ["default"])]
