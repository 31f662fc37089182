"""Percentiles of very large numeric columns, by mergeable randomized compactor hierarchies.

A sketch is a list of levels; an item of level h stands for 2^h values. A level that is full is sorted and every other
item moves up, starting at a coin toss. Each compaction at level h changes the rank of any value by at most 2^h, up or
down with equal chance, so that the sum of 4^h over all compactions bounds the error; the sketch carries that sum.

Coins come from a generator that each sketch carries in its state. It starts from the seed of the call, the group and the
task, so that sketches toss independently even where their data are equal, and a task that runs again after the loss of an
executor makes the same sketch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import durable

#: Items of the top level; lower levels shrink by SHRINK, but keep LEAST. Sketches merged in one task at a time.
K, SHRINK, LEAST, FAN_IN = 2048, 2 / 3, 16, 64
#: Items a task keeps over all its groups before it hands on what it has.
HELD = 2_000_000


_MASK = (1 << 64) - 1


def _mixed(x: int) -> int:
    """A 64-bit finalizer: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & _MASK
    x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & _MASK
    return x ^ (x >> 33)


class Sketch:
    """A compactor hierarchy over doubles. NaN and NULL must be left out by the caller; infinities are values.

    ``coin`` is the state of its generator. Sketches that are to be merged need different ones, or their errors add up.
    """

    __slots__ = ("k", "coin", "n", "err", "low", "high", "levels", "pending")

    def __init__(self, k: int = K, coin: int = 0):
        self.k, self.coin, self.n, self.err, self.low, self.high = k, coin & _MASK, 0, 0.0, math.inf, -math.inf
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.pending: list[np.ndarray] = []

    def room(self, h: int) -> int:
        return max(LEAST, math.ceil(self.k * SHRINK ** (len(self.levels) - 1 - h)))

    def add(self, values: np.ndarray) -> None:
        if not len(values):
            return
        self.n += len(values)
        self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
        self.pending.append(values)
        if sum(map(len, self.pending)) >= 4 * self.k:
            self._settle()

    def _settle(self) -> None:
        if self.pending:
            self.levels[0] = np.concatenate([self.levels[0], *self.pending])
            self.pending = []
        self._compress()

    def _toss(self) -> int:
        self.coin = (self.coin + 0x9E3779B97F4A7C15) & _MASK
        return _mixed(self.coin) & 1

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            full = self.levels[h]
            if len(full) > self.room(h) and sum(map(len, self.levels)) > sum(self.room(i) for i in range(len(self.levels))):
                items = np.sort(full)
                keep = items[-1:] if len(items) % 2 else items[:0]
                even = items[: len(items) - len(keep)]
                if h + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                self.levels[h], self.levels[h + 1] = keep, np.concatenate([self.levels[h + 1], even[self._toss() :: 2]])
                self.err += 4.0**h
                h = -1
            h += 1

    def merge(self, other: "Sketch") -> None:
        """Take over ``other``. The smaller k and with it the larger error goes on."""
        self.k = min(self.k, other.k)
        self._settle()
        other._settle()
        while len(self.levels) < len(other.levels):
            self.levels.append(np.empty(0))
        for h, items in enumerate(other.levels):
            self.levels[h] = np.concatenate([self.levels[h], items])
        self.n, self.err = self.n + other.n, self.err + other.err
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        self.coin = _mixed(self.coin ^ _mixed(other.coin))
        self._compress()

    def size(self) -> int:
        return sum(map(len, self.levels)) + sum(map(len, self.pending))

    def state(self) -> dict:
        self._settle()
        coin = self.coin - (1 << 64) if self.coin >> 63 else self.coin
        return {"k": self.k, "coin": coin, "n": self.n, "err": self.err, "low": self.low, "high": self.high, "sizes": [len(x) for x in self.levels], "items": np.concatenate(self.levels)}

    @classmethod
    def of(cls, k: int, coin: int, n: int, err: float, low: float, high: float, sizes, items) -> "Sketch":
        s = cls(int(k), int(coin))
        s.n, s.err, s.low, s.high = int(n), float(err), float(low), float(high)
        s.levels = np.split(np.asarray(items, dtype=float), np.cumsum(np.asarray(sizes, dtype=int))[:-1])
        return s

    def quantiles(self, shares: list[float]) -> list[float]:
        """For each share p the item at rank ceil(p n), at least 1: for an exact sketch a value of the data."""
        self._settle()
        items = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(x), 1 << h, dtype=np.int64) for h, x in enumerate(self.levels)])
        order = np.argsort(items, kind="stable")
        items, ranks = items[order], np.cumsum(weights[order])
        at = np.searchsorted(ranks, [max(1, math.ceil(p * self.n)) for p in shares])
        return [self.low if p <= 0 else self.high if p >= 1 else float(items[min(i, len(items) - 1)]) for p, i in zip(shares, at)]

    def rank_error(self, delta: float = 0.01) -> float:
        """The share of n by which a rank is off at most, with probability 1 - delta (Hoeffding); 0 for an exact sketch."""
        return math.sqrt(2 * math.log(2 / delta) * self.err) / self.n if self.n else 0.0


STATE = "k int, coin long, n long, err double, low double, high double, sizes array<int>, items array<double>"
PARTS = ["k", "coin", "n", "err", "low", "high", "sizes", "items"]


def sketches(df: DataFrame, groups: list[str], value: str, k: int = K, seed: int = 1) -> DataFrame:
    """(``groups``, k, coin, n, err, low, high, sizes, items): one mergeable sketch for each group with a value.

    Give separate calls, for instance of separate days, separate seeds unless the day is among the groups: sketches of the
    same seed, group and task toss the same coins.

    NULL group keys form a group of their own. NULL and NaN values do not count; all others do, infinities too. Equal
    values and repeated rows count as often as they occur. Empty input gives no sketch. The result can be stored and
    merged with others by merge_sketches, for instance of another day. Tasks sketch their own rows first, so that a group
    of any size is shuffled as a few thousand numbers a task, and merge FAN_IN of those at a time.
    """
    kept = df.select(*groups, F.col(value).cast("double").alias("_value")).filter(F.col("_value").isNotNull() & ~F.isnan("_value"))
    fields = [kept.schema[g] for g in groups]


    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        held: dict[tuple, Sketch] = {}
        handed = 0

        def out() -> pd.DataFrame:
            nonlocal handed
            rows = [(*key, task, *s.state().values()) for key, s in held.items()]
            held.clear()
            handed += 1
            return pd.DataFrame(rows, columns=[*groups, "_task", *PARTS])

        for pdf in batches:
            if not len(pdf):
                continue
            codes, keys = _codes(pdf, groups)
            order = np.argsort(codes, kind="stable")
            values = pdf["_value"].to_numpy(float)[order]
            cuts = np.flatnonzero(np.diff(codes[order])) + 1
            for start, part in zip(np.concatenate([[0], cuts]), np.split(values, cuts)):
                key = keys[codes[order[start]]]
                if key not in held:
                    held[key] = Sketch(k, xxhash.xxh3_64_intdigest(repr((key, task, handed)).encode("utf-8", "surrogatepass"), seed=seed & _MASK))
                held[key].add(part)
            if sum(s.size() for s in held.values()) > HELD:
                yield out()
        if held:
            yield out()

    narrow = kept.select(*[_portable(kept, g) for g in groups], "_value")
    parts = durable(narrow.mapInPandas(run, ", ".join([f"`{g}` string" for g in groups] + ["_task int", STATE])), "sketches")
    tasks = (parts.agg(F.max("_task")).first()[0] or 0) + 1
    level = FAN_IN
    while level < tasks:
        parts = _merged(parts.withColumn("_task", F.floor(F.col("_task") / level).cast("int")), [*groups, "_task"])
        parts = parts.withColumn("_task", F.col("_task") * level)
        level *= FAN_IN
    whole = _merged(parts.drop("_task"), groups)
    return whole.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields], *PARTS)


def _portable(df: DataFrame, name: str):
    return F.col(f"`{name}`").cast("string").alias(name)


def _codes(pdf: pd.DataFrame, groups: list[str]) -> tuple[np.ndarray, list[tuple]]:
    """Group number of each row, and the key of each number; None stands for NULL."""
    codes = np.zeros(len(pdf), dtype=np.int64)
    for g in groups:
        c, u = pd.factorize(pdf[g], use_na_sentinel=False)
        codes = codes * len(u) + c
    _, first, codes = np.unique(codes, return_index=True, return_inverse=True)
    keys = [tuple(None if pd.isna(x) else x for x in row) for row in pdf[groups].iloc[first].itertuples(index=False)]
    return codes, keys


def _merged(parts: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches with the same ``groups`` become one.

    Rows come sorted by group, so that a task walks through any number of groups in one pass and holds one sketch at a
    time; the order within a group is that of the sketches, so that the result does not depend on who came first.
    """
    types = {f.name: f.dataType.simpleString() for f in parts.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, out = None, None, []
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                key, mine = tuple(None if pd.isna(x) else x for x in row[: len(groups)]), Sketch.of(*row[len(groups) :])
                if held is not None and key == at:
                    held.merge(mine)
                    continue
                if held is not None:
                    out.append((*at, *held.state().values()))
                at, held = key, mine
                if len(out) >= 500:
                    yield pd.DataFrame(out, columns=[*groups, *PARTS])
                    out = []
        if held is not None:
            out.append((*at, *held.state().values()))
        yield pd.DataFrame(out, columns=[*groups, *PARTS])

    keys = [F.col(f"`{g}`") for g in groups]
    near = parts.repartition(*keys) if keys else parts.coalesce(1)
    schema = ", ".join([f"`{g}` {types[g]}" for g in groups] + [STATE])
    return near.select(*keys, *PARTS).sortWithinPartitions(*keys, "n", "low", "high", "err", "coin").mapInPandas(run, schema)


def merge_sketches(parts: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of several partitions or days, merged to one for each of the remaining ``groups``.

    A group merges in steps of FAN_IN, so that no task gets more than some FAN_IN sketches however many a group has.
    """
    fields = [parts.schema[g] for g in groups]
    others = [c for c in parts.columns if c not in {*groups, *PARTS}]
    most = parts.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0
    cur = parts.select(*[_portable(parts, g) for g in groups], F.xxhash64(*([F.col(f"`{c}`") for c in others] or [F.col("n"), F.col("low"), F.col("high"), F.col("coin")])).alias("_spread"), *PARTS)
    while most > FAN_IN:
        n = -(-most // FAN_IN)
        cur = _merged(cur.withColumn("_spread", F.pmod("_spread", F.lit(n))), [*groups, "_spread"])
        most = n
    whole = _merged(cur.drop("_spread"), groups)
    return whole.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields], *PARTS)


def percentiles(merged: DataFrame, groups: list[str], shares: list[float], delta: float = 0.01) -> DataFrame:
    """(``groups``, n, low, high, rank_error, percentiles): the values at ``shares`` of each sketch.

    rank_error is the share of n by which the rank of each value is off at most, with probability 1 - delta.
    """
    fields = [merged.schema[g] for g in groups]
    schema = ", ".join([f"`{f.name}` string" for f in fields] + ["n long, low double, high double, rank_error double, percentiles array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                s = Sketch.of(*row[len(groups) :])
                found = s.quantiles(shares)
                out.append((*row[: len(groups)], s.n, s.low, s.high, s.rank_error(delta), found))
            yield pd.DataFrame(out, columns=[*groups, "n", "low", "high", "rank_error", "percentiles"])

    plain = merged.select(*[_portable(merged, g) for g in groups], *PARTS).mapInPandas(run, schema)
    return plain.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields], "n", "low", "high", "rank_error", "percentiles")


#: The percentiles that are reported for each outlet.
SHARES = [0.05, 0.5, 0.9, 0.99]


def daily_sketches(posts: DataFrame, k: int = K) -> DataFrame:
    """One sketch of zcreatedat for each zaccount (NULL is a group) and ingest day, written once."""
    return durable(sketches(posts.select("zaccount", F.to_date("ingested_at").alias("ingest_day"), "zcreatedat"), ["zaccount", "ingest_day"], "zcreatedat", k), "daily")


def _shown(found: DataFrame, groups: list[str]) -> DataFrame:
    return found.select(*groups, "n", *[F.col("percentiles")[i].alias(f"p{round(100 * p):02d}") for i, p in enumerate(SHARES)], "rank_error")


def post_time_percentiles(posts: DataFrame, k: int = K) -> DataFrame:
    """zcreatedat percentiles of each zaccount (NULL is a group) over all days, from the sketches of the ingest days merged."""
    return _shown(percentiles(merge_sketches(daily_sketches(posts, k), ["zaccount"]), ["zaccount"], SHARES), ["zaccount"])


def daily_percentiles(posts: DataFrame, k: int = K) -> DataFrame:
    """zcreatedat percentiles of each zaccount and ingest day (NULL is a group in either)."""
    return _shown(percentiles(daily_sketches(posts, k), ["zaccount", "ingest_day"], SHARES), ["zaccount", "ingest_day"])
