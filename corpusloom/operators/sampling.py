"""Deterministic samples and allocations."""

from __future__ import annotations

import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ranks import rank_within, with_rank
from corpusloom.session import broadcast_if_small

_ALL = (1 << 64) - 1
#: Strata that an allocation is made for at most; more are refused.
MAX_STRATA = 100_000


class SplitMix64:
    """The SplitMix64 generator with wrapping unsigned arithmetic."""

    def __init__(self, seed: int):
        self.state = seed & _ALL

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & _ALL
        z = self.state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _ALL
        return z ^ (z >> 31)


def draw_positions(n: int, count: int, seed: int) -> list[int]:
    """Which of ``n`` sorted candidates the partial Fisher-Yates shuffle puts first; holds ``count`` numbers, not n."""
    g, moved, out = SplitMix64(seed), {}, []
    for i in range(min(max(count, 0), n)):
        j = i + g.next() % (n - i)
        out.append(moved.get(j, j))
        moved[j] = moved.get(i, i)
    return out


def draw(keys: list[str], excluded: set[str], count: int, seed: int) -> list[str]:
    """Of the sorted keys without the excluded ones the first ``count`` after a partial Fisher-Yates shuffle."""
    pool = sorted(set(keys) - excluded)
    return [pool[i] for i in draw_positions(len(pool), count, seed)]


def at_positions(pool: DataFrame, key: str, positions: Callable[[int], list[int]]) -> DataFrame:
    """(``key``, place): the keys at chosen positions of the sorted pool, in the order of the choice.

    The choice needs only the number of keys; the keys are ranked where they are and never come to the driver.
    """
    ranked = with_rank(pool.select(key).filter(F.col(key).isNotNull()).distinct(), [key], "_nr")
    chosen = positions(ranked.count())
    rows = pool.sparkSession.createDataFrame([(p + 1, i) for i, p in enumerate(chosen)], "_nr long, place int")
    return ranked.join(broadcast_if_small(rows, len(chosen)), "_nr").drop("_nr")


def drawn_exactly(pool: DataFrame, key: str, excluded: DataFrame, count: int, seed: int) -> DataFrame:
    """draw() over a distributed pool, with the same result."""
    rest = pool.select(key).join(excluded.select(key), key, "left_anti")
    return at_positions(rest, key, lambda n: draw_positions(n, count, seed))


def drawn(pool: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """P1 at scale: the ``count`` keys of least seeded hash. Another sample than draw(), as deterministic, without a driver."""
    return pool.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key, F.lit(seed)), key).limit(count)


def allocate(sizes: dict[str, int], total: int) -> dict[str, int]:
    """How many to draw from each stratum.

    Everything if ``total`` covers all; one each to the largest strata if there are more strata than ``total``; else one
    each, the rest in proportion by largest remainder, never more than a stratum has; what caps leave over goes round in
    the same order. Equal remainders go to the larger stratum, then by name.
    """
    filled = {k: v for k, v in sizes.items() if v > 0}
    if total >= sum(filled.values()):
        return {k: filled.get(k, 0) for k in sizes}
    if total < len(filled):
        first = sorted(filled, key=lambda k: (-filled[k], k))[: max(total, 0)]
        return {k: int(k in first) for k in sizes}
    out = {k: 1 for k in filled}
    rest, whole = total - len(filled), sum(filled.values())
    exact = {k: rest * v / whole for k, v in filled.items()}
    for k in filled:
        out[k] = min(filled[k], out[k] + int(exact[k]))
    turn = sorted(filled, key=lambda k: (-(exact[k] - int(exact[k])), -filled[k], k))
    left = total - sum(out.values())
    while left:
        for k in turn:
            if left and out[k] < filled[k]:
                out[k], left = out[k] + 1, left - 1
    return {k: out.get(k, 0) for k in sizes}


def stratified(rows: DataFrame, stratum: str, key: str, total: int, seed: int) -> DataFrame:
    """``allocate`` over the counts of ``stratum``, then the rows of least seeded hash of each stratum.

    Strata are counted on the driver, so there may be MAX_STRATA of them (an error beyond). Rows are ranked within their
    stratum over ranges of the whole table, so that no stratum is ever short and none gathers in one task. NULL strata and
    rows with a NULL key are left out.
    """
    named = rows.withColumn("_s", F.col(stratum).cast("string")).filter(F.col("_s").isNotNull() & F.col(key).isNotNull())
    counts = dict(map(tuple, named.groupBy("_s").count().limit(MAX_STRATA + 1).collect()))
    if len(counts) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata")
    limits = rows.sparkSession.createDataFrame(list(allocate(counts, total).items()), "_s string, _most long")
    ranked = rank_within(named.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))), ["_s"], ["_h", key], "_place")
    return ranked.join(F.broadcast(limits), "_s").filter(F.col("_place") <= F.col("_most")).select(*rows.columns)


def control_sample(pool: DataFrame, key: str, labelled: DataFrame, ratio: float, n_positive: int, seed: int) -> DataFrame:
    """round(ratio n) keys of the pool without any labelled one, as Python's seeded generator samples the sorted keys."""
    rest = pool.select(key).join(labelled.select(key), key, "left_anti")
    return at_positions(rest, key, lambda n: random.Random(seed).sample(range(n), min(n, round(ratio * n_positive))))


def folds(rows: DataFrame, label: str, key: str, k: int, seed: int) -> DataFrame:
    """Fold 0 ... k-1 of each row, balanced by class: hash order within a class, dealt in turn."""
    ranked = with_rank(rows.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))), [label, "_h", key], "_r")
    return ranked.withColumn("fold", F.pmod(F.col("_r") - 1, F.lit(k)).cast("int")).drop("_h", "_r")


def second_pass(batch: dict) -> dict:
    """A second pass over the same URIs."""
    return {"passNumber": 2, "sourceBatchID": batch["id"], "drawnURIs": list(batch["drawnURIs"]), "labelledURIs": []}


def undrawn(pool: DataFrame, batches: DataFrame, key: str = "zuri") -> DataFrame:
    """The pool without what any batch has drawn. batches: (drawn array<string>)."""
    return pool.join(batches.select(F.explode("drawn").alias(key)).distinct(), key, "left_anti")


def unlabelled(drawn: DataFrame, done: DataFrame, batch: str, key: str) -> DataFrame:
    """U4: (``batch``, ``key``): what each batch has drawn and nobody has labelled; a place column would give the order."""
    return drawn.select(batch, key).distinct().join(done.select(batch, key), [batch, key], "left_anti")


def complete(drawn: DataFrame, done: DataFrame, batch: str, key: str) -> DataFrame:
    """(``batch``, complete): whether all a batch has drawn is labelled; labels on others do not count."""
    marks = drawn.select(batch, key, F.lit(False).alias("_l")).unionByName(done.select(batch, key, F.lit(True).alias("_l")))
    per = marks.groupBy(batch, key).agg(F.bool_or("_l").alias("_done"), F.bool_or(~F.col("_l")).alias("_drawn")).filter("_drawn")
    return per.groupBy(batch).agg(F.bool_and("_done").alias("complete"))


def uniform_numbers(seed: int, n: int) -> pd.DataFrame:
    """The first ``n`` numbers of a seeded generator, as signed 64-bit values."""
    g = SplitMix64(seed)
    values = [g.next() for _ in range(n)]
    return pd.DataFrame({"at": range(n), "value": [v - (1 << 64) if v >> 63 else v for v in values]})
