"""Analyses, logs, metrics, samples, threads, channels and sources on small fixtures with known results."""

import gzip
import json
import math
import random
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import channels, classify, deletions, incremental, integrity, latest, metrics, sampling, structure, threads
from corpusloom.operators.ranks import percentiles_within
from corpusloom.sources import documents, jsonl, sqlite
from tests_support import posts, reply, root


def test_escalation_fixture(spark):
    """Two depth-1 parents (0.9, 0.1) and four depth-2 children (0.9, 0.1, 0.1, 0.1)."""
    rows = [root(1), reply(10, "a"), reply(11, "b"), reply(12, "c", depth=2, parent="p10"), reply(13, "c", depth=2, parent="p10"), reply(14, "c", depth=2, parent="p11"), reply(15, "c", depth=2, parent="p11")]
    p = posts(spark, rows)
    scores = spark.createDataFrame([("p10", 0.9), ("p11", 0.1), ("p12", 0.9), ("p13", 0.1), ("p14", 0.1), ("p15", 0.1)], "uri string, score double")
    cube = structure.escalation(structure.scored_replies(p, scores), scores)
    two = cube.filter("outlet_name = '1' AND depth_bucket = '2'").first()
    assert (two["bad_after_bad"], two["n_after_bad"], two["bad_after_good"], two["n_after_good"], two["n"], two["small_n"]) == (1, 2, 0, 2, 4, True)
    one = cube.filter("outlet_name = 'ALL' AND depth_bucket = '1'").first()
    assert (one["n_after_bad"], one["n_after_good"], one["n"], one["n_base_uncivil"], one["p_base"]) == (0, 0, 2, 1, 0.5)
    integrity.leaves_add_up(cube, "n", 6, ["outlet_name", "depth_bucket"])
    with pytest.raises(integrity.ReconciliationError):
        integrity.leaves_add_up(cube, "n", 7, ["outlet_name", "depth_bucket"])


def test_unscored_is_not_zero(spark):
    p = posts(spark, [root(1), reply(10, "a"), reply(11, "a"), reply(12, "b")])
    got = {r["zauthordid"]: r for r in structure.author_scores(structure.scored_replies(p, spark.createDataFrame([("p10", 0.8)], "uri string, score double"))).collect()}
    assert (got["a"]["n_scored"], got["a"]["mean_score"], got["b"]["mean_score"], got["b"]["mass"]) == (1, 0.8, None, 0.0)


@pytest.mark.parametrize("xs", [[0.0, 0.0], [1.0], [1.0, 2.0, 3.0, 10.0], [5.0] * 6, []])
def test_gini_and_top_share(spark, xs):
    df = spark.createDataFrame(list(enumerate(xs)), "k int, x double")
    got, n, t = structure.gini(df, "x", "k").first()[0], len(xs), sum(xs)
    assert math.isclose(got, sum(abs(a - b) for a in xs for b in xs) / (2 * n * t) if t else 0.0, abs_tol=1e-12)
    share = structure.top_share(df.withColumn("r", F.col("k") + 1), "x", "r", 0.3)
    assert share == (None if not t else sum(xs[: max(1, round(n * 0.3))]) / t)


def test_concentration_ranks_all_authors(spark):
    """Shares go by volume over all authors and by mean over eligible ones, and not by mass."""
    per = [(f"a{i:04d}", 2000 - i, 12 if i >= 1500 else 0, i / 2000 if i >= 1500 else None, 12 * i / 2000 if i >= 1500 else 0.0) for i in range(2000)]
    df = spark.createDataFrame(per, "zauthordid string, reply_count long, n_scored long, mean_score double, mass double").repartition(7)
    got = {r["zauthordid"]: (r["volume_rank"], r["mean_rank"]) for r in structure.ranked_authors(df).collect()}
    assert got["a0000"] == (1, None) and got["a1999"] == (2000, 1) and got["a1500"] == (1501, 500)
    one = structure.concentration(df).first()
    mass = [12 * i / 2000 for i in range(1500, 2000)]
    assert (one["n_authors"], one["n_authors_no_score"], one["n_eligible_for_mean_rank"]) == (2000, 1500, 500)
    assert (one["top1pct_share_by_volume"], one["top10pct_share_by_volume"]) == (0.0, 0.0)
    assert math.isclose(one["top1pct_share_by_mean_score"], sum(mass[-5:]) / sum(mass)) and math.isclose(one["top10pct_share_by_mean_score"], sum(mass[-50:]) / sum(mass))
    none = structure.concentration(df.limit(0)).first()
    assert (none["n_authors"], none["n_replies"], none["gini"], none["top1pct_share_by_volume"]) == (0, 0, 0.0, None)


def test_percentiles_within(spark):
    rows = [(g, float(x)) for g, n in (("a", 1), ("b", 2), ("c", 7), (None, 4)) for x in range(n)] + [("a", None), ("b", float("nan")), ("d", None)]
    got = {r["g"]: (r["m"], r["p"]) for r in percentiles_within(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], "x", {"m": 0.5, "p": 0.9}).collect()}
    assert {k: (round(a, 9), round(b, 9)) for k, (a, b) in got.items()} == {"a": (0.0, 0.0), "b": (0.5, 0.9), "c": (3.0, 5.4), None: (1.5, 2.7)}

def test_deciles_are_not_ntiles(spark):
    df = spark.createDataFrame([(f"u{i:02d}", float(i // 2)) for i in range(23)], "uri string, score double")
    got = [r["decile"] for r in structure.deciles(df).orderBy("score", "uri").collect()]
    assert got == [min(9, 10 * i // 23) + 1 for i in range(23)]


def test_retracted_labels(spark):
    log = spark.createDataFrame([("u", "hate", 1.0, False, 1), ("u", "hate", 2.0, True, 2), ("v", "hate", None, False, 3)], "uri string, val string, cts double, neg boolean, seq int")
    assert {r["uri"] for r in latest.active_then_latest(log).collect()} == {"u", "v"}
    assert {r["uri"] for r in latest.latest_then_active(log).collect()} == {"v"}
    assert tuple(latest.sweep_subjects(log).first()) == (2, 0)


def test_reasons_are_not_drops(spark):
    n = spark.createDataFrame([(1, "human", "hate", "b1", 9), (2, "human", "hate", None, 9), (3, "human", "hate", "bx", 9), (4, "human", "skip", "b1", 9), (5, "human", "hate", "b2", 9), (6, "llm", "hate", "b1", 9), (7, "human", "hate", "b3", 9), (8, "human", "hate", "b4", 9)], "z_pk int, stage string, class string, batch string, post int")
    b = spark.createDataFrame([("b1", "uniformRandom", 1), ("b2", "filtered", 1), ("b3", "uniformRandom", 2), ("b4", None, 1)], "batch string, kind string, pass int")
    got = {r["z_pk"]: r["reason"] for r in latest.batch_outcomes(n, b).collect()}
    assert got == {1: "counted", 2: "no_batch", 3: "unknown_batch", 4: "no_class", 5: "not_random", 7: "second_pass", 8: "bad_frame"}
    assert latest.base_rate(latest.batch_outcomes(n.limit(0), b)).first()["status"] == "no_data"


def test_kappa_fixture(spark):
    pairs = [("x", "x")] * 4 + [("y", "y")] * 4 + [("x", "y"), ("y", "x")]
    r = metrics.kappa(spark.createDataFrame(pairs, "a string, b string"), "a", "b").first()
    assert (r["n"], round(r["agreement"], 9), round(r["kappa"], 9)) == (10, 0.8, 0.6)
    assert metrics.kappa(spark.createDataFrame([("x", "x")], "a string, b string"), "a", "b").first()["kappa"] == 1.0
    none = metrics.kappa(spark.createDataFrame([], "a string, b string"), "a", "b").first()
    assert (none["n"], none["agreement"], none["kappa"]) == (0, None, None)


@pytest.mark.parametrize("seed", [1, 2])
def test_auc_and_precision_by_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([0.1, 0.4, 0.4, 0.7, 0.9]), rng.random() < 0.4, rng.choice("ab")) for _ in range(60)]
    df = spark.createDataFrame(rows, "s double, y boolean, g string").repartition(5)
    def auc(rs):
        pos, neg = [s for s, y, _ in rs if y], [s for s, y, _ in rs if not y]
        return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert math.isclose(metrics.roc_auc(df, "s", "y").first()["auc"], auc(rows))
    for r in metrics.roc_auc(df, "s", "y", ["g"]).collect():
        assert math.isclose(r["auc"], auc([x for x in rows if x[2] == r["g"]]))
    cuts = sorted({s for s, _, _ in rows}, reverse=True)
    n_pos, before, ap, best = sum(y for _, y, _ in rows), 0, 0.0, (0, 0)
    for c in cuts:
        tp, fl = sum(y for s, y, _ in rows if s >= c), sum(s >= c for s, _, _ in rows)
        ap += (tp - before) / n_pos * tp / fl
        before = tp
        best = max(best, (2 * tp / (fl + n_pos), -c))
    assert math.isclose(metrics.average_precision(df, "s", "y").first()[0], ap)
    f1 = metrics.best_f1(df, "s", "y").first()
    assert math.isclose(f1["f1"], best[0]) and f1["threshold"] == -best[1]
    assert metrics.roc_auc(df.filter("y"), "s", "y").first()["auc"] is None


def test_spearman_of_constants_is_null(spark):
    df = spark.createDataFrame([(1, 0.5, 0.1), (2, 0.5, 0.9)], "k int, a double, b double")
    assert metrics.spearman(df, "a", "b", "k").first()["spearman"] is None
    up = spark.createDataFrame([(i, i / 9, i * i / 81) for i in range(10)], "k int, a double, b double")
    assert math.isclose(metrics.spearman(up, "a", "b", "k").first()["spearman"], 1.0)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.integers(0, 40), max_size=6), st.integers(0, 120))
def test_allocation(sizes, total):
    out = sampling.allocate(sizes, total)
    assert sum(out.values()) == min(total, sum(sizes.values()))
    assert all(0 <= out[k] <= sizes[k] for k in sizes)
    if total >= sum(v > 0 for v in sizes.values()):
        assert all(out[k] for k, v in sizes.items() if v)


def test_allocation_gives_equal_remainders_to_larger_strata():
    """{a: 3, b: 11, c: 6} with 13: after one each 10 are dealt, 1.5, 5.5 and 3.0; the two of remainder 0.5 differ in size."""
    assert sampling.allocate({"a": 3, "b": 11, "c": 6}, 13) == {"a": 2, "b": 7, "c": 4}
    assert sampling.allocate({"z": 5, "y": 5}, 3) == {"z": 1, "y": 2}


def test_objects_in_answers():
    assert classify.first_object('The char "{" matters: {"class":"hate"}') == '{"class":"hate"}'
    assert classify.first_object('}} {"a": "}"} {') == '{"a": "}"}'
    assert classify.first_object('say "a { b" {"a": {"b": 1}}') == '{"a": {"b": 1}}'
    assert classify.first_object("{ open") is None and classify.first_object(None) is None


def test_draws(spark):
    g = sampling.SplitMix64(0)
    assert [g.next() for _ in range(2)] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4]
    keys = [f"k{i}" for i in range(50)]
    assert sampling.draw(keys, {"k1"}, 10, 5) == sampling.draw(keys[::-1], {"k1"}, 10, 5)
    assert len(set(sampling.draw(keys, {"k1"}, 99, 5))) == 49
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    exact = sampling.drawn_exactly(df.union(df), "k", df.filter("k = 'k1'"), 10, 5).orderBy("place").collect()
    assert [r["k"] for r in exact] == sampling.draw(keys, {"k1"}, 10, 5)
    control = sampling.control_sample(df, "k", df.filter("k < 'k2'"), 1.5, 5, 3).orderBy("place").collect()
    assert [r["k"] for r in control] == random.Random(3).sample(sorted(k for k in keys if k >= "k2"), 8)
    assert sampling.drawn(df, "k", 7, 1).collect() == sampling.drawn(df.repartition(5), "k", 7, 1).collect()
    rows = df.withColumn("s", F.when(F.col("k") < "k2", "a").otherwise("b"))
    counts = {r["s"]: r["count"] for r in sampling.stratified(rows, "s", "k", 12, 3).groupBy("s").count().collect()}
    assert sum(counts.values()) == 12
    fold = sampling.folds(rows, "s", "k", 5, 1).groupBy("fold").count().collect()
    assert {r["count"] for r in fold} == {10}


def test_flat_order_and_layout(spark):
    edges = spark.createDataFrame([("r", None, 0.0), ("a", "r", 2.0), ("b", "r", 1.0), ("c", "a", 3.0), ("d", "a", 3.0)], "k string, p string, t double")
    flat = threads.flat_order(edges, "k", "p", "t")
    assert [r["node"] for r in flat.orderBy("position").collect()] == ["r", "b", "a", "c", "d"]
    at = {r["node"]: (r["x"], r["y"]) for r in threads.layout(flat, edges, "k", "p").collect()}
    assert at == {"b": (14.0, 81.0), "c": (42.0, 129.0), "d": (70.0, 129.0), "a": (56.0, 81.0), "r": (42.0, 33.0)}


def test_payloads(spark):
    def node(u, *replies):
        return {"post": {"uri": u}, "replies": list(replies)}
    deep = node("z")
    for i in range(500):
        deep = node(f"n{i}", deep)
    texts = [json.dumps(node("r", node("a", node("b")), {"notFound": True, "replies": [node("lost")]}, {"blocked": True})), "broken", None, json.dumps([1]), json.dumps(node("q", deep)).replace('"q"', '"q"')]
    got = threads.flattened(spark.createDataFrame([(t,) for t in texts[:4]], "j string"), "j").collect()
    assert {tuple(r) for r in got} == {("r", "a", "r", 0), ("r", "b", "a", 1)}


def test_channels(spark):
    m = spark.createDataFrame([("c", i, f"2024-01-0{1 + i // 5}T00:00:00Z", "x" if i % 2 else None, "t" if i != 9 else "") for i in (1, 2, 3, 6, 7, 9)], "channel string, msg_id long, sent_at string, fwd_from_channel string, text string")
    assert {r["day"]: r["n_missing"] for r in channels.day_coverage(m).collect()} == {"2024-01-01": 0, "2024-01-02": 1}
    assert channels.contiguous_top(m).first()["contiguous_top"] == 3
    assert [tuple(r)[2:] for r in channels.gap_ranges(m).collect()] == [(8, 8)]
    assert channels.forward_evidence(m, spark.createDataFrame([("x",)], "username string")).count() == 0
    assert channels.may_become("seed_candidate", "seed_approved") and not channels.may_become("dead", "seed_approved")
    assert channels.trailing_streak(m.withColumn("s", F.col("text") == ""), "msg_id", "s", "channel").first()["streak"] == 1


def test_deletions_fixture(spark):
    archive = [reply(10, "gone"), reply(11, "kept"), reply(12, "never", to=3), reply(13, "partial", to=2), root(1), root(2), root(3)]
    status = {1: "complete", 2: "inProgress", 3: "pending"}
    live = [reply(11, "kept"), *[(*root(k)[:-1], s) for k, s in status.items()]]
    got = deletions.deleted(posts(spark, archive), posts(spark, live)).collect()
    assert {(r["zauthordid"], r["complete"]) for r in got} == {("gone", True), ("partial", False)}


def test_incremental(spark):
    stored = spark.createDataFrame([("a", 1, "t"), ("b", 2, "u")], "k string, n int, text string")
    fresh = spark.createDataFrame([("a", 5, "new"), ("b", None, "new"), ("c", 3, "v")], "k string, n int, text string")
    assert {tuple(r) for r in incremental.merged_engagement(stored, fresh, "k", ["n"]).collect()} == {("a", 5, "t"), ("b", 2, "u"), ("c", 3, "v")}
    log = spark.createDataFrame([("x", "failed", "c1", 100.0), ("x", "success", None, 50.0), ("y", "failed", "c2", 0.0)], "acc string, status string, cursor string, at double")
    assert {r["acc"]: r["cursor"] for r in incremental.resume_cursor(log, "acc", 48 * 3600.0 + 50).collect()} == {"x": "c1", "y": None}
    presets = spark.createDataFrame([("p", "new text"), ("q", "q text")], "name string, template string")
    mine = spark.createDataFrame([("p", "old", False), ("own", "mine", True), ("gone", "x", False)], "name string, template string, is_default boolean")
    got = {r["name"]: (r["template"], r["is_default"]) for r in incremental.reconciled(presets, mine, ["gone"]).collect()}
    assert got == {"p": ("new text", False), "q": ("q text", False), "own": ("mine", True)}


def test_integrity(spark):
    with pytest.raises(integrity.ReconciliationError):
        integrity.reconcile("x", 1, 2)
    with pytest.warns(UserWarning):
        integrity.reconcile("x", 1, 2, allow=True)
    with pytest.raises(integrity.ReconciliationError):
        integrity.require_complete({"run_status": "partial"})
    with pytest.raises(integrity.ReconciliationError):
        integrity.require_no_labels(spark.range(1))
    with pytest.raises(integrity.ReconciliationError):
        integrity.require_schema(spark.range(1), spark.createDataFrame([], "name string").schema)
    assert "name" in integrity.optional_columns(spark.range(1), spark.createDataFrame([], "name string").schema).columns


@pytest.mark.parametrize("given, found", [('x {"a": "}"} y', '{"a": "}"}'), ('} {"a": {"b": 1}}', '{"a": {"b": 1}}'), ('{"a": "\\"}"}', '{"a": "\\"}"}'), ("none", None), ("{open", None), (None, None)])
def test_first_object(given, found):
    assert classify.first_object(given) == found


def test_answers(spark):
    good = classify.parse_answer('Sure: {"class": "Hate", "confidence": 7, "severity": "null"}')
    assert (good["class"], good["confidence"], good["severity"]) == ("hate", 1.0, None)
    assert classify.parse_answer('{"class": "other"}') is None and classify.parse_answer("[]") is None
    df = spark.createDataFrame([(1, "You are scum, really"), (2, "hi"), (3, None), (4, "a fine long text")], "id long, t string")
    got = {r["id"]: (r["class"], r["confidence"]) for r in classify.annotated(df, "id", "t", "stub:scum").collect()}
    assert got == {1: ("hate", 0.75), 2: ("neutral", 0.0), 3: ("neutral", 0.0), 4: ("neutral", 0.75)}


def test_trainers(spark):
    rows = [(f"good {w} day", 0) for w in "abcdefgh"] + [(f"bad {w} scum", 1) for w in "abcdefgh"]
    df = spark.createDataFrame(rows, "t string, y int")
    out = classify.tfidf_logistic(df, "t", "y").transform(df)
    assert out.filter(F.col("prediction") != F.col("y")).count() == 0
    vectors = classify.word_vectors(df.withColumn("w", F.split("t", " ")), "w", 4, 2)
    assert vectors.getVectors().count() >= 4


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "s.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE ZPOST (Z_PK INTEGER PRIMARY KEY, ZTEXT VARCHAR, ZCREATEDAT TIMESTAMP, ZB BLOB)")
        c.executemany("INSERT INTO ZPOST VALUES (?, ?, ?, ?)", [(i, f"t{i}", i / 2, b"x") for i in range(1, 101)] + [(200, None, "soon", None)])
        c.execute("CREATE TABLE EMPTY (A INTEGER)")
    df = sqlite.read_sqlite(spark, path, "ZPOST")
    assert df.count() == 101 and df.filter("Z_PK = 200").first()["ZCREATEDAT"] is None
    assert sqlite.read_sqlite(spark, path, "EMPTY").count() == 0
    df.createOrReplaceTempView("zp")
    assert sqlite.query(spark, "SELECT count(*) FROM zp WHERE ZTEXT = :t", t="t7' OR 1=1").first()[0] == 0


def test_logs(spark, tmp_path):
    a, b = tmp_path / "scores-1.jsonl", tmp_path / "scores-2.jsonl.gz"
    rec = lambda u, s: json.dumps({"uri": u, "head": "h", "score": s, "model_id": "m", "model_revision": "1", "scored_at": "x"})
    a.write_text("\n".join([rec("u", 0.1), "", "broken", rec("u", 0.2), rec("v", 0.3)]) + "\n")
    b.write_bytes(gzip.compress((rec("v", 0.4) + "\n").encode()))
    log = jsonl.read_log(spark, f"{tmp_path}/scores-*", jsonl.SCORES)
    assert {r["uri"]: r["score"] for r in jsonl.last_records(log, ["uri"]).collect()} == {"u": 0.2, "v": 0.4}
    assert jsonl.first_model(log, "h") == ("m", "1")
    (tmp_path / "scores-1.summary.json").write_text(json.dumps({"run_status": "complete"}))
    assert jsonl.newest_complete(f"{tmp_path}/scores-*.jsonl*") == str(a)
    out = str(tmp_path / "sealed")
    jsonl.write_jsonl(spark.range(3), out)
    jsonl.seal(out)
    assert jsonl.verify(out) and spark.read.json(out).count() == 3
    part = next(n for n in (tmp_path / "sealed").iterdir() if n.name.startswith("part-"))
    part.write_bytes(b"x")
    assert not jsonl.verify(out)


def test_documents(spark, tmp_path):
    html = '<div class="message" data-post="chan/12"><a class="message_forwarded" href="https://t.example/o/3">o</a><div class="message_text">Hi<br/><b>you</b> &amp; me</div><span class="message_views">1.2K</span><time datetime="2024-01-01T00:00:00Z">x</time></div>'
    got = documents.page_messages(spark.createDataFrame([(html,), (None,), ("<p>",)], "h string"), "h").collect()
    assert [tuple(r) for r in got] == [("chan", 12, "2024-01-01T00:00:00Z", "Hi\nyou & me", "1.2K", "https://t.example/o/3", None)]
    md = tmp_path / "review.md"
    md.write_text("# x\n## at://a/1\nclass: hate\nnotes: see class: neutral\nreviewed: yes\n## at://a/2\nclass:\n")
    assert [tuple(r) for r in documents.review_entries(spark, str(md)).collect()] == [("at://a/1", "hate", None, "see class: neutral", True), ("at://a/2", None, None, None, False)]
    path = str(tmp_path / "o.csv")
    documents.write_csv(spark.createDataFrame([(1, 0.5), (2, None)], "a int, b double"), path, ["note"], 4)
    assert open(path).read() == "# note\na,b\n1,0.5000\n2,\n"
    assert [tuple(r) for r in documents.read_csv(spark, path, "a int, b double").collect()] == [(1, 0.5), (2, None)]
    assert "| 1 | 0.5000 |" in documents.markdown(spark.createDataFrame([(1, 0.5)], "a int, b double"), "T", ["c"])
    seeds = tmp_path / "seeds.csv"
    seeds.write_text("username,title,source_list\na,A,x\nb,B,x\nb,C,x\n")
    assert [tuple(r) for r in documents.imported_seeds(spark, str(seeds), spark.createDataFrame([("a",)], "username string")).collect()] == [("b", "B", "x")]


def test_streams(spark, tmp_path):
    from corpusloom.streaming import weekly

    rows = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("a", "2024-01-07 23:00:00"), ("b", "2024-01-08 00:00:00"), ("a", "2024-01-01 10:00:00")], "k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    counts = weekly.weekly_counts(weekly.stream(spark, str(tmp_path / "in"), rows), "t", [])
    q = counts.writeStream.outputMode("complete").format("memory").queryName("wk").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {str(r["week"]): r["n"] for r in spark.table("wk").collect()} == {"2024-01-01": 3, "2024-01-08": 1}
    for _ in range(2):
        weekly.append_batches(weekly.stream(spark, str(tmp_path / "in"), rows), str(tmp_path / "out"), str(tmp_path / "cp"), ["k", "t"]).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_sources_and_annotations_over_all_posts(spark):
    import __spark_entry__ as e

    sf = "/root/testdata/sf0.001"
    posts = spark.read.parquet(f"{sf}/zpost.parquet")
    back = e.queries()["S1_sqlite_posts"](spark, sf)
    assert back.rdd.getNumPartitions() > 1
    assert sorted(map(str, back.collect())) == sorted(map(str, posts.select("z_pk", "zuri", "zparenturi", "zisrootpost").collect()))
    got = e.queries()["X1_all_annotations"](spark, sf)
    assert got.count() == posts.select("zuri").distinct().count()
