"""Batch application of pluggable models, keyword enrichment and guarded query expansion."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusengine.functions.text import collapse, fallback_keywords, is_blank, is_unsafe, mask_pii, nfkc, sentences
from corpusengine.operators.dedup import MIN_LEN, near_duplicates, signatures
from corpusengine.operators.sequences import with_dense_id
from corpusengine.session import materialize

ModelFn = Callable[[list], list]

# Fixed value: stored when a model returned an empty answer.
EMPTY_ANSWER = "I'm sorry, I was unable to generate a response."
# Rows that a task holds as Python objects at once, rounded up to a batch of the model.
HELD_ROWS = 512
# Words whose cells a task remembers.
HELD_WORDS = 100_000


class _Cells(dict):
    """Cells of words, worked out when first asked for."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        cell = self[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dim
        return cell

    def __reduce__(self):
        return _Cells, (self.dim,)


def hash_embedder(dim: int = 64) -> ModelFn:
    """Deterministic embedding: word counts hashed into `dim` cells, scaled to length 1."""
    cells = _Cells(dim)

    def embed(texts: list) -> list:
        out = []
        for text in texts:
            places = np.fromiter(map(cells.__getitem__, text.lower().split()), np.intp)
            counts = np.bincount(places, minlength=dim).astype(np.float64)
            length = np.sqrt(counts @ counts)
            out.append((counts / length if length else counts).astype(np.float32))
        return out

    return embed


def _call(model_fn: ModelFn, inputs: list, retries: int, backoff: float, timeout: float | None) -> tuple[list, str | None]:
    error = None
    for attempt in range(1, retries + 2):
        try:
            if timeout is None:
                answers = model_fn(inputs)
            else:
                pool = ThreadPoolExecutor(1)
                try:
                    answers = pool.submit(model_fn, inputs).result(timeout)
                finally:
                    pool.shutdown(wait=False)
            if len(answers) != len(inputs):
                raise ValueError(f"{len(answers)} answers for {len(inputs)} inputs")
            return list(answers), None
        except Exception as failure:
            error = f"{type(failure).__name__}: {failure}"
            if attempt <= retries:
                time.sleep(backoff**attempt)
    return [None] * len(inputs), error


def _call_apart(
    model_fn: ModelFn, inputs: list, retries: int, backoff: float, timeout: float | None
) -> list[tuple[object, str | None]]:
    """Answer and error of each input; a failing batch is called again in halves, without further retries."""
    answers, error = _call(model_fn, inputs, retries, backoff, timeout)
    if error is None or len(inputs) == 1:
        return [(a, error) for a in answers]
    half = len(inputs) // 2
    return [x for part in (inputs[:half], inputs[half:]) for x in _call_apart(model_fn, part, 0, backoff, timeout)]


def apply_model(
    df: DataFrame,
    col: str,
    model_fn: ModelFn,
    out: str = "answer",
    returns: T.DataType = T.StringType(),
    batch_size: int = 8,
    retries: int = 2,
    backoff: float = 2.0,
    timeout: float | None = None,
) -> DataFrame:
    """Adds `out` and `error`: `model_fn` over batches of `col`, null and the reason on failure.

    A batch that still fails after its retries is halved until the inputs at fault stand alone, so
    only they get null, whatever the batch size and the partitions.  Null inputs are passed
    over.  Concurrency is the number of partitions.

    A task's Arrow batch becomes Python objects some `HELD_ROWS` rows at a time, and their answers leave before the
    next ones are made, so that memory does not grow with the rows of an Arrow batch.
    """
    result = T.StructType([T.StructField("value", returns), T.StructField("error", T.StringType())])
    value_type = to_arrow_type(returns)

    def packed(values: list, errors: list) -> pa.Array:
        parts = [pa.array(values, value_type, from_pandas=True), pa.array(errors, pa.string())]
        return pa.StructArray.from_arrays(parts, ["value", "error"])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            values, errors, done = [], [], 0
            rows = np.flatnonzero(texts.is_valid())
            for at in range(0, len(rows), batch_size):
                some = rows[at : at + batch_size]
                answers = _call_apart(model_fn, texts.take(pa.array(some)).to_pylist(), retries, backoff, timeout)
                for i, (answer, error) in zip(some.tolist(), answers, strict=True):
                    gap = [None] * (i - done - len(values))
                    values += [*gap, answer]
                    errors += [*gap, error]
                if len(values) >= HELD_ROWS:
                    yield packed(values, errors)
                    done, values, errors = done + len(values), [], []
            gap = [None] * (len(texts) - done - len(values))
            if values or gap:
                yield packed(values + gap, errors + gap)

    # Spelled out because annotations are strings here.
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    called = F.arrow_udf(run, result)
    return df.withColumn("_m", called(F.col(col))).select(
        *[c for c in df.columns if c not in (out, "error")],
        F.col("_m.value").alias(out),
        F.col("_m.error").alias("error"),
    )


class Breaker:
    """Stops calling a model after `limit` failed calls in a row; a call that succeeds starts the count anew."""

    def __init__(self, limit: int):
        self.limit, self.failures = limit, 0

    @property
    def open(self) -> bool:
        return self.failures >= self.limit

    def report(self, error: str | None) -> None:
        self.failures = 0 if error is None else self.failures + 1


def _accepted(
    model_fn: ModelFn, inputs: list, accept: Callable[[object], str | None], batch_size: int, retries: int,
    backoff: float, timeout: float | None, breaker: Breaker,
) -> list[tuple[object, str | None, int]]:
    """Answer, reason of the last refusal and number of attempts of every input."""
    out: list = [(None, "not asked", 0)] * len(inputs)
    open_rows, alone = list(range(len(inputs))), set()
    for attempt in range(1, retries + 2):
        if attempt > 1:
            time.sleep(backoff ** (attempt - 1))
        together = [i for i in open_rows if i not in alone]
        groups = [together[at : at + batch_size] for at in range(0, len(together), batch_size)]
        groups += [[i] for i in open_rows if i in alone]
        open_rows = []
        for group in groups:
            if breaker.open:
                for i in group:
                    out[i] = (None, f"model given up after {breaker.limit} failed calls", out[i][2])
                continue
            answers, error = _call(model_fn, [inputs[i] for i in group], 0, backoff, timeout)
            breaker.report(error)
            for i, answer in zip(group, answers, strict=True):
                reason = error or accept(answer)
                out[i] = (None if reason else answer, reason, out[i][2] + 1)
                if reason:
                    open_rows.append(i)
            if error:
                alone.update(group)  # asked one by one from now on, so that one bad input spoils no other
        if not open_rows or breaker.open:
            break
    return out


def apply_accepted(
    df: DataFrame,
    col: str,
    model_fn: ModelFn,
    accept: Callable[[object], str | None],
    out: str = "answer",
    returns: T.DataType = T.StringType(),
    batch_size: int = 8,
    retries: int = 2,
    backoff: float = 2.0,
    timeout: float | None = None,
    give_up: int = 5,
) -> DataFrame:
    """Adds `out`, `error` and `attempts`: answers that `accept` does not refuse, asked for again while it does.

    `accept` gets an answer and returns the reason why it cannot be used, or None.  Only refused
    inputs are asked again, after `backoff ** attempt` seconds, at most `retries` times; those of a call that
    failed as a whole are then asked one by one.  After `give_up` failed calls in a row a task stops asking, so
    a model that is down costs `give_up` calls and not some for every input.  Null inputs are passed over.
    """
    result = T.StructType(
        [T.StructField("value", returns), T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType())]
    )

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        breaker = Breaker(give_up)
        for texts in batches:
            rows = [i for i, t in enumerate(texts) if t is not None]
            found = _accepted(model_fn, [texts.iloc[i] for i in rows], accept, batch_size, retries, backoff, timeout, breaker)
            table: list = [(None, None, 0)] * len(texts)
            for i, answer in zip(rows, found, strict=True):
                table[i] = answer
            value, error, attempts = (pd.Series([t[c] for t in table], dtype=object) for c in range(3))
            yield pd.DataFrame({"value": value, "error": error, "attempts": attempts.astype("int32")})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    called = F.pandas_udf(run, result)
    return df.withColumn("_m", called(F.col(col))).select(
        *[c for c in df.columns if c not in (out, "error", "attempts")],
        F.col("_m.value").alias(out),
        F.col("_m.error").alias("error"),
        F.col("_m.attempts").alias("attempts"),
    )


def refuse_no_json_map(answer: object) -> str | None:
    """Why an answer is no JSON object with an entry, code fences aside."""
    text = str(answer or "").strip()
    fenced = re.match(r"(?s)^```(?:json)?(.*?)(?:```|$)", text)
    try:
        found = json.loads(fenced.group(1) if fenced else text)
    except ValueError:
        return "no JSON"
    if not isinstance(found, dict) or not found:
        return "no JSON object with an entry"
    return None


def refuse_no_list(answer: object) -> str | None:
    """Why an answer holds no JSON array of strings."""
    text = str(answer or "")
    start, end = text.find("["), text.rfind("]") + 1
    try:
        found = json.loads(text[start:end]) if start >= 0 else None
    except ValueError:
        return "no JSON array"
    return None if isinstance(found, list) and found and all(isinstance(x, str) for x in found) else "no JSON array of strings"


def prefix_for(model_name: str, kind: str) -> str:
    """Nomic models want `search_document: ` or `search_query: ` before the text."""
    return f"search_{kind}: " if "nomic" in model_name.lower() else ""


def embed(
    df: DataFrame, col: str, model_fn: ModelFn | None = None, model_name: str = "hash", kind: str = "document",
    out: str = "embedding", batch_size: int = 256, **options,
) -> DataFrame:
    """Adds the vector `out` of every text; null where the model failed."""
    text = F.concat(F.lit(prefix_for(model_name, kind)), F.col(col))
    asked = apply_model(
        df.withColumn("_prompt", text), "_prompt", model_fn or hash_embedder(), out,
        T.ArrayType(T.FloatType()), batch_size, **options,
    )
    return asked.drop("_prompt")


def complete(df: DataFrame, prompt: str, model_fn: ModelFn, **options) -> DataFrame:
    """Adds `answer`; an empty one becomes the fixed sentence, a failed one stays null."""
    asked = apply_model(df, prompt, model_fn, "answer", **options)
    return asked.withColumn(
        "answer", F.when(F.col("answer") == "", F.lit(EMPTY_ANSWER)).otherwise(F.col("answer"))
    )


def batches(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Adds `batch_no` (from 1): consecutive groups of `n` rows in `order`."""
    return with_dense_id(df, order, "_row").withColumn(
        "batch_no", F.floor((F.col("_row") - 1) / n) + 1
    )


def keyword_requests(topics: DataFrame, n: int = 3, order: tuple[str, ...] = ("doc_id", "topic_seq"), chars: int = 500) -> DataFrame:
    """JSON payload of every request: `n` topics with the head of their text."""
    entry = F.struct(F.col("topic_id"), F.substring("text", 1, chars).alias("text"))
    grouped = batches(topics, n, list(order)).groupBy("batch_no").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_row"), entry.alias("entry")))).alias("rows")
    )
    return grouped.select("batch_no", F.to_json(F.transform("rows", lambda r: r["entry"])).alias("payload"))


def merge_answers(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Keywords per topic; the answer of the last batch wins."""
    return answers.groupBy(*keys).agg(F.max_by("keywords", "batch_no").alias("answered"))


def enrich(topics: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `keywords` and `keyword_source`: at least three answered keywords (first five), else the fallback."""
    merged = merge_answers(answers, keys)
    usable = F.coalesce(F.size("answered") >= 3, F.lit(False))
    return topics.join(merged, keys, "left").select(
        *[c for c in topics.columns if c not in ("keywords", "keyword_source")],
        F.when(usable, F.slice("answered", 1, 5)).otherwise(fallback_keywords(F.col("text"))).alias("keywords"),
        F.when(usable, "model").otherwise("fallback").alias("keyword_source"),
    )


def enrich_summary(enriched: DataFrame) -> DataFrame:
    return enriched.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("keyword_source") == "model").alias("from_model"),
        F.count_if(F.col("keyword_source") == "fallback").alias("from_fallback"),
    )


def guard_expansions(df: DataFrame, near: bool = True, limit: int = 2, min_chars: int = 5) -> DataFrame:
    """`expansions` per query: candidates that pass the guard and are new next to the query.

    `df`: query_id, query, candidates.  A query that fails the guard, or whose candidates all
    fail, stands for itself.
    """
    texts = df.select(
        "query_id",
        F.posexplode(F.concat(F.array("query"), F.slice("candidates", 1, limit))).alias("no", "raw"),
    )
    # As a generator's result: filters on a plain column would be moved below it and normalise each text twice.
    safe = texts.select("query_id", "no", F.explode_outer(F.array(nfkc(F.col("raw")))).alias("text")).where(
        ~is_blank(F.col("text")) & ~is_unsafe(F.col("text"))
    )
    rows = safe.select(
        "query_id", "no", F.posexplode(sentences(collapse(mask_pii(F.col("text"))))).alias("pos", "sentence")
    )
    free = F.length("sentence") < MIN_LEN
    own = F.when(free, F.struct("no", "pos"))
    kept = (
        rows.groupBy("query_id", "sentence", own.alias("_own"))
        .agg(F.min(F.struct("no", "pos")).alias("at"))
        .select("query_id", "at.no", "at.pos", "sentence")
    )
    if near:
        numbered = materialize(with_dense_id(kept, ["query_id", "no", "pos"], costly=True), "expansions")
        long = numbered.where(F.length("sentence") >= MIN_LEN)
        gone = near_duplicates(
            signatures(long, "sentence").select("id", "signature", "query_id"), scope=("query_id",)
        )
        kept = numbered.join(gone, "id", "left_anti")
    passed = (
        kept.groupBy("query_id", "no")
        .agg((F.sum(F.length("sentence") + 1) - 1).alias("chars"))
        .where(F.col("chars") > min_chars)
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list("no")).alias("passed"))
    )
    chosen = F.transform(F.filter("passed", lambda n: n > 0), lambda n: F.get("candidates", n - 1))
    usable = F.array_contains("passed", 0) & (F.size(chosen) > 0)
    return df.join(passed, "query_id", "left").select(
        "query_id",
        F.when(F.coalesce(usable, F.lit(False)), chosen).otherwise(F.array("query")).alias("expansions"),
    )
