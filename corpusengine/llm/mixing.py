"""Temperature mixing: source shares raised to an exponent, realised as block permutations within a budget.

The weight of a source is its share of all tokens to the power `alpha`, normalised.  `alpha` 1 keeps
the shares and 0 makes sources equal; it is bisected to the least value at which no source
is repeated more often than allowed and the entropy is no higher than its target.  The budget is the
least at which every source is used at least once in full, unless one is given.

A source's documents are permuted by a hash and cut into blocks.  A quota is met by whole
passes and then by a run of blocks: blocks before the last are taken whole, and only within the
last one documents are counted one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusengine.llm.common import ROW, SPACES, col, numbered, text_of
from corpusengine.session import materialize

#: No source is repeated more often than this.
MAX_REPEATS = 2.0
#: Documents of a block, about.
BLOCK = 5_000
#: Exponents tried in one pass over the sources, and the places to which the exponent is found.
GRID, PLACES = 32, 6


def tokens_of(text: Column) -> Column:
    """Words of a text, which count as its tokens; at least 1, so that no document is free."""
    plain = F.translate(text, SPACES, " " * len(SPACES))
    return F.greatest(F.size(F.array_remove(F.split(plain, " "), "")), F.lit(1)).cast("long")


def _measures(sources: DataFrame, exponents: list[float], total: float) -> list[tuple[float, float]]:
    """`(largest repetition, entropy)` at each exponent, in one aggregation.

    With weight `s ** a / Z` and a budget that uses each source once, the repetition of a source is
    its weight over its share, relative to the least such ratio.
    """
    share = F.col("tokens") / F.lit(total)
    columns = []
    for i, a in enumerate(exponents):
        power = F.pow(share, F.lit(a))
        ratio = F.pow(share, F.lit(a - 1.0))
        columns += [
            F.sum(power).alias(f"z{i}"), F.sum(power * F.log(power)).alias(f"e{i}"),
            (F.max(ratio) / F.min(ratio)).alias(f"r{i}"),
        ]
    row = sources.agg(*columns).first()
    return [(row[f"r{i}"], math.log(row[f"z{i}"]) - row[f"e{i}"] / row[f"z{i}"]) for i in range(len(exponents))]


def exponent(sources: DataFrame, max_repeats: float = MAX_REPEATS, max_entropy: float | None = None) -> float:
    """The least exponent in [0, 1], to `PLACES` places, that keeps both limits, 1 if none does.

    Repetition and entropy fall as the exponent rises.  Each pass over the table of sources
    tries `GRID` exponents, so the interval shrinks by that factor; no list of sources leaves the cluster.
    """
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0

    low, high, unit = 0, 10**PLACES, 10.0**-PLACES

    def fits(measure: tuple[float, float]) -> bool:
        repeats, entropy = measure
        return repeats <= max_repeats * (1 + 1e-12) and (max_entropy is None or entropy <= max_entropy + 1e-12)

    while low < high:
        tried = sorted({low + (high - low) * i // GRID for i in range(GRID)})
        good = [a for a, m in zip(tried, _measures(sources, [a * unit for a in tried], total), strict=True) if fits(m)]
        if good:
            high = good[0]
            bad = [a for a in tried if a < high]
            low = bad[-1] + 1 if bad else high
        else:
            low = tried[-1] + 1
    return low * unit


def quotas(sources: DataFrame, alpha: float, budget: int | None = None) -> DataFrame:
    """`(source, tokens, weight, quota)` at the exponent `alpha`.

    The default budget is the least at which every quota is at least the source's tokens.
    """
    power = F.pow(F.col("tokens").cast("double"), F.lit(alpha))
    total, scale = sources.agg(F.sum(power), F.max(F.col("tokens") / power)).first()
    weight = power / F.lit(total or 1.0)
    # Rounded first, as powers that should meet the tokens may fall a trifle short.
    quota = F.floor(F.round(power * F.lit(scale) if budget is None else weight * F.lit(float(budget)), 3))
    return sources.select("source", "tokens", weight.alias("weight"), quota.cast("long").alias("quota"))


def drawn(
    docs: DataFrame, text: str = "text", source: str = "source", max_repeats: float = MAX_REPEATS,
    max_entropy: float | None = None, budget: int | None = None, seed: int = 0,
) -> DataFrame:
    """`(ROW, doc_id, source, tokens, place, weight, copies)` of every row: how often it is drawn.

    `docs` is a table.  A null source is a source of its own, named null.  A source's documents are
    permuted by `place`, a hash of `doc_id`, `seed` and the row's number, which keeps repeated rows
    apart.  `copies` is the number of whole passes, and one more for those documents whose
    tokens, with all before them in the permutation, fit into the rest of the quota.
    """
    rows = numbered(docs, col("doc_id").cast("long").alias("doc_id"), col(source).cast("string").alias("source"), tokens_of(text_of(text)).alias("tokens"))
    rows = rows.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", ROW))
    sources = materialize(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "sources")
    alpha = exponent(sources, max_repeats, max_entropy)
    goals = quotas(sources, alpha, budget).select(
        "source", "weight", F.floor(F.col("quota") / F.col("tokens")).cast("long").alias("passes"),
        F.pmod("quota", "tokens").alias("rest"),
    )
    goals = goals.join(sources.select("source", F.ceil(F.col("n") / BLOCK).alias("blocks")), goals["source"].eqNullSafe(sources["source"])).select(
        goals["source"].alias("of"), "weight", "passes", "rest", "blocks"
    )
    goals = materialize(goals, "goals")
    # Blocks are equal ranges of the hash, in the order of the permutation.
    high = F.shiftrightunsigned("place", 32)
    first = F.col("place") < 0
    upper = F.when(first, high - F.lit(1 << 31)).otherwise(high + F.lit(1 << 31))
    blocked = rows.join(goals, F.col("source").eqNullSafe(F.col("of"))).withColumn(
        "block", F.floor(upper * F.col("blocks") / F.lit(float(1 << 32))).cast("long")
    )
    by_block = blocked.groupBy("of", "block").agg(F.sum("tokens").alias("size"))
    before = W.partitionBy("of").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = by_block.select(F.col("of").alias("s"), F.col("block").alias("b"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"), "size")
    starts = materialize(starts, "blocks")
    known = blocked.join(starts, F.col("of").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    whole = known.where(F.col("rest") >= F.col("before") + F.col("size")).withColumn("more", F.lit(1))
    none = known.where(F.col("rest") <= F.col("before")).withColumn("more", F.lit(0))
    within = W.partitionBy("of", "block").orderBy("place", ROW)
    last = known.where((F.col("rest") > F.col("before")) & (F.col("rest") < F.col("before") + F.col("size"))).withColumn(
        "more", (F.col("before") + F.sum("tokens").over(within) <= F.col("rest")).cast("int")
    )
    taken = whole.unionByName(none).unionByName(last)
    return taken.select(ROW, "doc_id", "source", "tokens", "place", "weight", (F.col("passes") + F.col("more")).alias("copies"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", **limits) -> DataFrame:
    """The columns of `docs`, every row as often as it is drawn, in no particular order."""
    counts = drawn(docs, text, source, **limits).select(F.col(ROW).alias("__llm_drawn"), "copies")
    whole = numbered(docs, F.struct(*[col(c) for c in docs.columns]).alias("doc"))
    joined = whole.join(counts, F.col(ROW) == F.col("__llm_drawn")).where("copies > 0")
    return joined.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("pass")).select("doc.*")
