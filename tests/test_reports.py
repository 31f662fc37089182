"""Whole reports and page walks on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import stats, text
from corpusloom.operators import compositions, latest, metrics
from corpusloom.sources.backfill import ChannelFolder, walk

SCHEMA = "channel string, msg_id long, text string, fetched_at string"


def pages(ids, size):
    """A channel of ``ids`` that is served newest first, ``size`` a page; and what was asked for."""
    asked = []
    def fetch(channel, before):
        asked.append(before)
        below = sorted((i for i in ids if before is None or i < before), reverse=True)[:size]
        return [{"msg_id": i, "text": f"m{i}", "fetched_at": f"t{len(asked):03d}"} for i in below]
    return fetch, asked


def ids_of(folder):
    return sorted(r["msg_id"] for r in folder.messages().collect())


def test_backfill_goes_on_where_it_broke_off(spark, tmp_path):
    folder = ChannelFolder(spark, str(tmp_path / "a"), SCHEMA)
    fetch, asked = pages(range(3, 26), 5)
    got = walk(folder, "c/1", fetch, max_pages=2)
    assert (got["status"], got["failure"], folder.state("c/1")) == ("failed", "page budget exhausted (2)", {"cursor": 16, "complete": False})
    got = walk(folder, "c/1", fetch)
    assert got["status"] == "complete" and asked[2] == 16 and ids_of(folder) == list(range(3, 26))
    assert folder.state("c/1") == {"cursor": None, "complete": True}
    assert walk(folder, "c/1", fetch)["status"] == "skipped" and len(asked) == 6
    assert walk(folder, "c/1", fetch, force=True)["fetched"] == 23 and ids_of(folder) == list(range(3, 26))


def test_walk_without_progress_or_network_fails(spark, tmp_path):
    folder = ChannelFolder(spark, str(tmp_path / "b"), SCHEMA)
    stuck = lambda channel, before: [{"msg_id": 9}, {"msg_id": 10}]
    assert walk(folder, "c", stuck)["failure"] == "no progress: the page before 9 begins at 9"
    def down(channel, before):
        raise ConnectionError("down")
    assert walk(folder, "d", down)["failure"] == "down"
    assert walk(folder, "d", down, incremental=True)["failure"] == "no history: run a backfill first"


def test_incremental_walk_passes_an_island_and_closes_the_gap(spark, tmp_path):
    folder = ChannelFolder(spark, str(tmp_path / "c"), SCHEMA)
    folder.add("c", [{"msg_id": i, "fetched_at": "t"} for i in (1, 2, 3, 4)])
    folder.add("c", [{"msg_id": i, "fetched_at": "t"} for i in (15, 16, 17)])
    fetch, asked = pages(range(1, 21), 3)
    assert folder.top("c") == 4 and walk(folder, "c", fetch, incremental=True)["status"] == "complete"
    assert ids_of(folder) == list(range(1, 21)) and asked == [None, 18, 15, 12, 9, 6] and folder.top("c") == 20


def test_comparison_needs_labels(spark):
    labels = spark.createDataFrame([(f"u{i}", i % 3 == 0) for i in range(30)], "uri string, hate boolean")
    scores = spark.createDataFrame([(f"u{i}", m, 0.9 if (i % 3 == 0) == (m == "a") else 0.1) for i in range(40) for m in "ab" if (i, m) != (1, "b")], "uri string, model string, score double")
    got = {r["model"]: r for r in compositions.comparison(scores, labels, "a", "b").collect()}
    assert (got["a"]["auc"], got["a"]["recall"], got["b"]["auc"], got["b"]["n_null"], got["b"]["n_compared"]) == (1.0, 1.0, 0.0, 1, 29)
    assert got["a"]["n_both"] == 39 and got["a"]["agreement"] == 0.0 and round(got["a"]["spearman"], 9) == -1.0
    with pytest.raises(ValueError):
        compositions.comparison(scores, labels.limit(29), "a", "b")


def test_benchmark_counts_absent_classes(spark):
    gold = spark.createDataFrame([(1, "hate"), (2, "neutral"), (3, "neutral")], "post long, truth string")
    said = spark.createDataFrame([(1, "m", "hate"), (2, "m", "neutral"), (3, "m", "neutral"), (9, "m", "hate")], "post long, model string, class string")
    r = compositions.benchmark(gold, said).first()
    assert (r["n"], r["accuracy"], r["f1_hate"], r["f1_counter"], round(r["macro_f1"], 9)) == (3, 1.0, 1.0, 0.0, round(2 / 3, 9))


def test_hard_first(spark):
    rows = spark.createDataFrame([("b", "core"), ("c", "hard"), ("a", None), ("d", "hard")], "k string, tag string")
    assert [r["k"] for r in latest.hard_first(rows, "k").collect()] == ["c", "d", "a", "b"]


def test_frame_summaries(spark):
    frames = {
        '{"kind": "uniformRandom", "outletPK": 3}': "uniform random", '{"kind": "filtered"}': "filtered (no filters set)", "{broken": "unknown frame (failed to decode)", None: "unknown frame (failed to decode)",
        '{"kind": "filtered", "outletPK": 3, "dateFrom": 0, "dateTo": 86400, "minThreadReplies": 2}': "filtered: outlet #3, 2001-01-01–2001-01-02, ≥2 replies/thread",
        '{"kind": "filtered", "dateTo": 0, "minThreadReplies": 2, "maxThreadReplies": 9}': "filtered: until 2001-01-01, 2–9 replies/thread",
    }
    df = spark.createDataFrame([(k,) for k in frames], "f string")
    assert {r["f"]: r["s"] for r in df.select("f", text.frame_summary(F.col("f")).alias("s")).collect()} == frames


def test_time_left(spark):
    df = spark.createDataFrame([(10.0, 0, 5), (10.0, 2, 5), (10.0, 5, 5)], "t double, a int, b int")
    assert [r[0] for r in df.select(stats.time_left(F.col("t"), F.col("a"), F.col("b"))).collect()] == [None, 15.0, None]


@pytest.mark.parametrize("block", [3, 100])
def test_nearest_in_blocks_of_queries(spark, block):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(60)] + [(60, [0.0] * 5), (61, None)]
    df = spark.createDataFrame(rows, "k long, v array<double>").repartition(4)
    got = {}
    for r in metrics.nearest(df, "k", "v", df.filter("k % 6 = 0"), 4, block).collect():
        got.setdefault(r["query"], []).append((-r["cosine"], r["match"]))
    size = lambda x: math.sqrt(sum(a * a for a in x))
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / (size(x) * size(y)) if size(x) * size(y) else 0.0
    assert set(got) == {k for k, v in rows if k % 6 == 0 and v}
    for q, found in got.items():
        want = sorted((-cos(rows[q][1], v), k) for k, v in rows if v and k != q)[:4]
        assert [round(c, 9) for c, _ in sorted(found)] == [round(c, 9) for c, _ in want]
    assert metrics.nearest(df, "k", "v", df.limit(0), 4).count() == 0
