"""Consensus and reliabilities on votes with a known truth."""

import random

from pyspark.sql import functions as F

from corpusloom.llm import consensus as c


def votes_of(people, n_items, seed, per_item=5):
    """people: name -> how it votes given the truth."""
    rng = random.Random(seed)
    truth, votes = {}, []
    for item in range(n_items):
        truth[item] = rng.choices(c.CLASSES, [3, 2, 5])[0]
        for name in rng.sample(sorted(people), min(per_item, len(people))):
            votes.append((item, name, people[name](truth[item], rng)))
    return truth, votes


def right(p):
    return lambda t, rng: t if rng.random() < p else rng.choice([x for x in c.CLASSES if x != t])


SWAP = {"hate": "counter", "counter": "hate", "neutral": "neutral"}
PEOPLE = {f"good{i}": right(0.9) for i in range(7)} | {f"fair{i}": right(0.7) for i in range(3)} | {"always": lambda t, rng: "hate", "dice": right(1 / 3), "swap": lambda t, rng: SWAP[t]}


def test_consensus_beats_the_majority(spark):
    truth, votes = votes_of(PEOPLE, 600, 1)
    df = spark.createDataFrame(votes, "item long, annotator string, label string").withColumn("w", F.lit(1)).withColumn("chance", F.lit("clash"))
    items, people = c.consensus(df)
    got = {r["item"]: r for r in items.collect()}
    by = {}
    for i, _, x in votes:
        by.setdefault(i, []).append(x)
    majority = sum(max(set(v), key=lambda x: (v.count(x), x)) == truth[i] for i, v in by.items())
    ours = sum(r["label"] == truth[i] for i, r in got.items())
    assert len(got) == 600 and ours >= 0.95 * 600 and ours > majority
    for i, r in list(got.items())[:50]:
        v = by[i]
        same = sum(v.count(x) * (v.count(x) - 1) for x in set(v))
        assert abs(r["agreement"] - same / (len(v) * (len(v) - 1))) < 1e-12 and 0 < r["probability"] <= 1
    rel = {r["annotator"]: r["reliability"] for r in people.collect()}
    assert min(rel[f"good{i}"] for i in range(7)) > max(rel[f"fair{i}"] for i in range(3)) > 0.3
    assert abs(rel["always"]) < 0.15 and abs(rel["dice"]) < 0.2 and rel["swap"] < rel["fair0"]
    assert all(abs(rel[f"good{i}"] - 0.85) < 0.12 for i in range(7))


def exact_fit(votes, rounds=200):
    """The reliabilities by the dense matrix: C[a, b] and m[a, b] of every pair, then the same fixed point."""
    import numpy as np

    people = sorted({a for _, a, _ in votes})
    at, k = {a: i for i, a in enumerate(people)}, len(c.CLASSES)
    p = np.zeros((len(people), k))
    for _, a, x in votes:
        p[at[a], c.CLASSES.index(x)] += 1
    shares = p.sum(0) / p.sum()
    p = (p + c.SMOOTHING * shares) / (p.sum(1, keepdims=True) + c.SMOOTHING)
    by = {}
    for i, a, x in votes:
        by.setdefault(i, []).append((at[a], x))
    C, m = np.zeros((len(people),) * 2), np.zeros((len(people),) * 2)
    for v in by.values():
        for a, x in v:
            for b, y in v:
                if a != b:
                    C[a, b] += (x == y) - p[a] @ p[b]
                    m[a, b] += 1
    w = np.ones(len(people))
    for _ in range(rounds):
        u = (C @ w) / (m @ w**2)
        w = u / np.sqrt((w @ C @ w) / (w**2 @ m @ w**2))
    return dict(zip(people, w / np.sqrt(1 - (shares**2).sum())))


def test_reliabilities_are_those_of_the_dense_matrix(spark):
    """With uneven overlaps: a few annotators share most of their posts, others hardly any."""
    rng = random.Random(9)
    _, votes = votes_of(PEOPLE, 300, 2, 4)
    votes = [x for x in votes if x[1] not in ("good0", "fair0") or x[0] % 10 == 0] + [(1000 + i, a, rng.choice(c.CLASSES)) for i in range(60) for a in ("good1", "dice")]
    want = exact_fit(votes)
    got = {r["annotator"]: r for r in c.reliabilities(spark.createDataFrame(votes, "item long, annotator string, label string")).collect()}
    assert all(abs(got[a]["reliability"] - max(-1, min(1, x))) < 2e-3 for a, x in want.items())
    assert all(r["residual"] < c.TOLERANCE for r in got.values())


def test_unsettled_iterations_say_so(spark):
    _, votes = votes_of(PEOPLE, 100, 3)
    assert c.reliabilities(spark.createDataFrame(votes, "item long, annotator string, label string"), rounds=1).first()["residual"] > c.TOLERANCE


def test_few_votes_ties_and_nothing(spark):
    schema = "item long, annotator string, label string"
    items, people = c.consensus(spark.createDataFrame([(1, "a", "hate"), (1, "b", "hate"), (2, "a", "neutral"), (2, "b", "counter"), (2, "d", "hate")], schema))
    assert [r["item"] for r in items.collect()] == [2]
    assert people.count() == 3
    items, people = c.consensus(spark.createDataFrame([], schema))
    assert items.count() == 0 and people.count() == 0
    items, people = c.consensus(spark.createDataFrame([(i, "only", "hate") for i in range(3)], schema), least=1)
    assert {r["label"] for r in items.collect()} == {"hate"} and people.first()["reliability"] == 0


def test_which_votes_count(spark):
    schema = "z_pk long, zstage string, zspeechclass string, zannotatorid string, zpost long, zcreatedat double"
    nan = float("nan")
    rows = [
        (1, "human", " Hate\n", "A ", 7, 1.0), (2, "human", "counter", "a", 7, 2.0), (3, "human", "neutral", " a", 7, 2.0), (4, "human", "hate", "a", 7, nan), (5, "human", "hate", "a", 7, None),
        (6, "llm", "hate", "b", 7, 9.0), (7, "human", "skip", "b", 7, 9.0), (8, "human", "hate", None, 7, 9.0), (9, "human", "hate", " ", 7, 9.0), (10, "human", "hate", "b", None, 9.0), (11, "human", None, "b", 7, 9.0),
    ]
    got = c.latest_votes(spark.createDataFrame(rows, schema)).collect()
    assert [tuple(r) for r in got] == [(7, "a", "neutral")]


def test_one_item_with_many_votes(spark):
    rows = [(0, f"p{i}", "hate" if i % 3 else "neutral") for i in range(900)] + [(1 + i % 40, f"p{i % 90}", "hate") for i in range(90)]
    items, people = c.consensus(spark.createDataFrame(rows, "item long, annotator string, label string"), least=1)
    assert {r["item"]: r["label"] for r in items.collect()}[0] == "hate" and people.count() == 900
