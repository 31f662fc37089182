"""Sketches against exact ranks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import quantiles as q


def rank_gap(values, x, p):
    """How far, as a share, the rank of x is from that of the p-quantile."""
    v, k = np.sort(values), max(1, math.ceil(p * len(values)))
    low, high = np.searchsorted(v, x, "left") + 1, np.searchsorted(v, x, "right")
    return max(0, low - k, k - high) / len(values)


@pytest.mark.parametrize("kind", ["uniform", "sorted", "reversed", "ties", "heavy"])
def test_rank_error_is_within_the_bound(kind):
    rng = np.random.default_rng(1)
    n = 200_000
    v = {"uniform": rng.random(n), "sorted": np.arange(n, dtype=float), "reversed": np.arange(n, 0, -1.0), "ties": rng.integers(0, 5, n).astype(float), "heavy": np.exp(rng.normal(0, 5, n))}[kind]
    s = q.Sketch(256)
    for part in np.array_split(v, 37):
        s.add(part)
    shares = [0, 0.01, 0.05, 0.5, 0.9, 0.99, 1]
    assert s.n == n and s.size() < 4 * 256 + 300
    for p, x in zip(shares, s.quantiles(shares)):
        assert rank_gap(v, x, p) <= s.rank_error(0.001)
    assert s.quantiles([0, 1]) == [v.min(), v.max()]


def test_merging_keeps_the_bound_and_the_count():
    rng = np.random.default_rng(2)
    parts = [rng.normal(i, 1, rng.integers(1, 3000)) for i in range(60)]
    whole = q.Sketch(256)
    for i, part in enumerate(parts):
        s = q.Sketch(256, i)
        s.add(part)
        whole.merge(q.Sketch.of(*s.state().values()))
    v = np.concatenate(parts)
    assert whole.n == len(v) == sum(len(x) << h for h, x in enumerate(whole.levels))
    for p, x in zip([0.05, 0.5, 0.95], whole.quantiles([0.05, 0.5, 0.95])):
        assert rank_gap(v, x, p) <= whole.rank_error(0.001)


def test_equal_parts_toss_their_own_coins():
    """Errors of 1,024 equal streams must cancel and not add up."""
    v = np.random.default_rng(5).permutation(60_000).astype(float)
    whole = None
    for i in range(1024):
        s = q.Sketch(256, q._mixed(i + 1))
        s.add(v)
        whole = s if whole is None else (whole.merge(s), whole)[1]
    shares = [0.05, 0.25, 0.5, 0.75, 0.9, 0.99]
    for p, x in zip(shares, whole.quantiles(shares)):
        assert abs((x + 1) / 60_000 - p) <= whole.rank_error(0.001) + 1 / 60_000


@pytest.mark.parametrize("k", [64, 8192])
def test_k_and_its_error_pass_through(spark, k):
    """What percentiles() states is the error of the sketch it reads, whatever its k."""
    df = spark.range(300_000).select(F.lit(1).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("v")).repartition(6)
    v = df.toPandas()["v"].to_numpy()
    made = q.sketches(df, ["g"], "v", k).first()
    s = q.Sketch.of(*[made[c] for c in q.PARTS])
    assert s.k == k and s.size() <= 3 * k + 16 * 40
    r = q.percentiles(q.merge_sketches(q.sketches(df, ["g"], "v", k), ["g"]), ["g"], [0.1, 0.5, 0.99], 0.001).first()
    assert r["rank_error"] == s.rank_error(0.001) and (r["rank_error"] < 0.001) == (k == 8192)
    assert all(rank_gap(v, x, p) <= r["rank_error"] for p, x in zip([0.1, 0.5, 0.99], r["percentiles"]))


def test_small_groups_are_exact():
    s = q.Sketch()
    s.add(np.array([3.0, 1.0, 2.0, math.inf]))
    assert s.quantiles([0.25, 0.5, 0.51, 1.0]) == [1.0, 2.0, 3.0, math.inf] and s.rank_error() == 0


def test_the_same_input_gives_the_same_sketch():
    v = np.random.default_rng(3).random(50_000)
    a, b = q.Sketch(128), q.Sketch(128)
    a.add(v.copy())
    b.add(v.copy())
    assert a.quantiles([0.1, 0.5]) == b.quantiles([0.1, 0.5])


def test_groups_nulls_and_clashing_names(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), rng.choice(["x", None]), rng.choice([1.0, 2.0, float("nan"), None, float("inf")])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g long, d string, v double").withColumn("n", F.lit(0)).withColumn("items", F.lit("clash")).repartition(5)
    daily = q.sketches(df, ["g", "d"], "v", 64)
    merged = q.percentiles(q.merge_sketches(daily, ["g"]), ["g"], [0.5])
    got = {r["g"]: (r["n"], r["percentiles"][0]) for r in merged.collect()}
    for g in (1, 2, None):
        v = sorted(x for a, _, x in rows if a == g and x is not None and x == x)
        n, x = got[g]
        assert n == len(v) and rank_gap(v, x, 0.5) <= 0.1
    assert q.sketches(df.limit(0), ["g"], "v").count() == 0
    assert q.sketches(df.filter("v IS NULL"), ["g"], "v").count() == 0


def test_many_sketches_merge_in_steps(spark, monkeypatch):
    monkeypatch.setattr(q, "FAN_IN", 4)
    df = spark.range(3000).select(F.lit(1).alias("g"), (F.col("id") % 40).alias("d"), F.col("id").cast("double").alias("v")).repartition(11)
    r = q.percentiles(q.merge_sketches(q.sketches(df, ["g", "d"], "v", 64), ["g"]), ["g"], [0.5, 1.0]).first()
    assert r["n"] == 3000 and abs(r["percentiles"][0] - 1500) < 3000 * r["rank_error"] and r["percentiles"][1] == 2999.0


def test_hot_group(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 50).alias("g"), F.col("id").cast("double").alias("v"))
    got = {r["g"]: r for r in q.percentiles(q.sketches(df, ["g"], "v"), ["g"], [0.5]).collect()}
    assert sum(r["n"] for r in got.values()) == 60_000
