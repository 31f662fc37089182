"""Queries that go through files and formats and back, through model answers, and through nested payloads."""

from __future__ import annotations

import sqlite3
import uuid

from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import channels, classify, model, threads, weekly
from corpusloom.operators.ranks import rank_within
from corpusloom.plans.reader import SQL as READER
from corpusloom.plans.views import LABELS, LATEST, MESSAGES, NOTES, POSTS, SCORES, Views
from corpusloom.session import shared_dir
from corpusloom.sources import documents, jsonl, sqlite

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def _folder(v: Views) -> str:
    return f"{shared_dir(v.spark)}/files-{uuid.uuid4().hex}"


def _local(path: str) -> str:
    return path.removeprefix("file://")


W, A = f"WITH {POSTS}", f"WITH {POSTS}, {NOTES}"
S = f"{A}, {SCORES}, {LATEST}"


@query("S1_sqlite_scan", "SELECT z_pk, zhandle, zisactive FROM ztrackedaccount")
def _(v):
    path = _local(_folder(v)) + ".db"
    rows = [tuple(r) for r in v.raw("ztrackedaccount").select("z_pk", "zhandle", "zisactive").collect()]  # outlets: a fixed dimension
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE ZTRACKEDACCOUNT (z_pk INTEGER PRIMARY KEY, zhandle VARCHAR, zisactive INTEGER)")
        c.executemany("INSERT INTO ZTRACKEDACCOUNT VALUES (?, ?, ?)", rows)
    return sqlite.read_sqlite(v.spark, path, "ZTRACKEDACCOUNT")


@query("S1_sqlite_posts", "SELECT z_pk, zuri, zparenturi, zisrootpost FROM zpost")
def _(v):
    path = _local(_folder(v)) + ".db"
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE ZPOST (z_pk INTEGER PRIMARY KEY, zuri VARCHAR, zparenturi VARCHAR, zisrootpost INTEGER)")

    def write(rows):
        with sqlite3.connect(path, timeout=3600) as own:  # tasks take turns; a repeated task replaces its rows
            own.executemany("INSERT OR REPLACE INTO ZPOST VALUES (?, ?, ?, ?)", map(tuple, rows))

    v.raw("zpost").select("z_pk", "zuri", "zparenturi", "zisrootpost").foreachPartition(write)
    return sqlite.read_sqlite(v.spark, path, "ZPOST")


@query("S2_bound_query", "SELECT z_pk FROM zpost WHERE ztext = 'That is popular.'")
def _(v):
    name = f"posts_{uuid.uuid4().hex}"
    v.raw("zpost").createOrReplaceTempView(name)
    return sqlite.query(v.spark, f"SELECT z_pk FROM {name} WHERE ztext = :wanted", wanted="That is popular.")


def _score_files(v: Views) -> str:
    path = _folder(v)
    rows = v.scores.select("uri", "head", "score", F.col("model").alias("model_id"), F.lit("1").alias("model_revision"), F.col("scored_at").cast("string").alias("scored_at"), "seq")
    jsonl.write_jsonl(rows.repartitionByRange("seq").sortWithinPartitions("seq").drop("seq"), path)
    return path


@query("S6_last_of_log", f"{S} SELECT uri, score FROM ls")
def _(v):
    return jsonl.last_records(jsonl.read_log(v.spark, _score_files(v), jsonl.SCORES), ["uri"]).select("uri", "score")


@query("S10_log_records", f"{S} SELECT uri, score, model AS model_id FROM s")
def _(v):
    return jsonl.read_log(v.spark, _score_files(v), jsonl.SCORES).select("uri", "score", "model_id")


@query("S7_label_log", f"{A}, {LABELS} SELECT val, neg, count(*) AS n FROM l GROUP BY ALL")
def _(v):
    path = _folder(v)
    rows = v.labels.select(F.col("uri").alias("subject"), F.lit("post").alias("subject_type"), F.lit("x").alias("src"), "val", F.col("cts").cast("string").alias("cts"), "neg")
    jsonl.write_jsonl(rows, path, gz=False)
    return jsonl.read_log(v.spark, path, jsonl.LABELS).groupBy("val", "neg").agg(F.count("*").alias("n"))


@query("S11_csv_and_back", READER["J20_weekly_activity"])
def _(v):
    path = _local(_folder(v)) + ".csv"
    documents.write_csv(weekly.weekly_activity(v.posts).orderBy("week"), path, ["weeks begin on Mondays"])
    return documents.read_csv(v.spark, path, "week date, n_roots bigint, n_replies bigint")


@query("S17_page_messages", f"WITH {MESSAGES} SELECT channel, msg_id, coalesce(text, '') AS text FROM m")
def _(v):
    safe = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    block = F.concat(F.lit('<div class="message" data-post="'), "channel", F.lit("/"), F.col("msg_id").cast("string"), F.lit('"><div class="message_text">'), safe, F.lit("</div></div>"))
    pages = v.messages.select("channel", F.floor(F.col("msg_id") / 20).alias("page"), block.alias("block")).groupBy("channel", "page").agg(F.concat_ws("\n", F.collect_list("block")).alias("html"))
    return documents.page_messages(pages, "html").select("channel", "msg_id", "text")


@query("S18_new_seeds", "SELECT username, title FROM channels WHERE status <> 'seed_approved'")
def _(v):
    path, c = _folder(v), v.raw("channels")
    c.select("username", "title", "source_list").write.option("header", True).csv(path)
    return documents.imported_seeds(v.spark, path, c.filter("status = 'seed_approved'").select("username")).select("username", "title")


@query("S19_benchmark_uris", "SELECT DISTINCT uri FROM evalset WHERE uri IS NOT NULL")
def _(v):
    path = _folder(v)
    v.raw("evalset").agg(F.to_json(F.collect_list(F.struct("uri", "text"))).alias("value")).write.text(path)  # 240 items, fixed
    return documents.benchmark_uris(v.spark, path)


@query("T3_flattened", f"{W} SELECT zparenturi AS root, zuri AS uri, zparenturi AS parent, CAST(0 AS BIGINT) AS depth FROM p WHERE zparenturi <> ''")
def _(v):
    kids = v.posts.filter("zparenturi <> ''").select("zparenturi", "zuri")
    paged = rank_within(kids, ["zparenturi"], ["zuri"], "place").withColumn("page", F.floor(F.col("place") / 50))
    node = F.struct(F.struct(F.col("zuri").alias("uri")).alias("post"))
    payload = F.to_json(F.struct(F.struct(F.col("zparenturi").alias("uri")).alias("post"), F.collect_list(node).alias("replies")))
    return threads.flattened(paged.groupBy("zparenturi", "page").agg(payload.alias("payload")), "payload")


@query("C13_parsed_answers", f"{A} SELECT z_pk, class, least(1.0, greatest(0.0, coalesce(confidence, 0))) AS confidence, severity FROM a WHERE stage = 'llm' AND class IN ('hate', 'counter', 'neutral')")
def _(v):
    rows = v.notes.filter("stage = 'llm'")
    answer = F.concat(F.lit('The char "{" matters, } so: '), F.to_json(F.struct("class", "confidence", "severity", F.lit('so "{" it is').alias("reasoning"))), F.lit(" and {more"))
    found = classify.parsed(rows.select("z_pk", answer.alias("answer")), "answer").filter("parsed IS NOT NULL")
    return found.select("z_pk", "parsed.class", "parsed.confidence", "parsed.severity")


@query("C7_view_counts", f"WITH {MESSAGES} SELECT channel, msg_id, CASE WHEN view_count >= 1000 THEN CAST(view_count // 1000 AS BIGINT) * 1000 ELSE view_count END AS views FROM m")
def _(v):
    shown = F.when(F.col("view_count") >= 1000, F.concat(F.expr("view_count div 1000").cast("string"), F.lit("K"))).otherwise(F.col("view_count").cast("string"))
    return v.messages.select("channel", "msg_id", text.view_count(shown).alias("views"))


@query("C8_link_parts", f"WITH {MESSAGES} SELECT channel, msg_id FROM m")
def _(v):
    channel, number = text.link_parts(F.concat(F.lit("https://t.example/s/"), "channel", F.lit("/"), F.col("msg_id").cast("string")))
    return v.messages.select(channel.alias("channel"), number.alias("msg_id"))


@query("X1_stub_annotations", f"{W} SELECT z_pk, CASE WHEN length(regexp_replace(coalesce(ztext, ''), '^\\s+|\\s+$', '', 'g')) >= 10 AND contains(lower(ztext), 'fehlt') THEN 'hate' ELSE 'neutral' END AS class FROM p WHERE zisrootpost = 1")
def _(v):
    return classify.annotated(model.roots(v.posts).select("z_pk", "ztext"), "z_pk", "ztext", "stub:fehlt").select("z_pk", "class")


@query("X1_all_annotations", f"{W} SELECT z_pk, CASE WHEN length(regexp_replace(coalesce(ztext, ''), '^\\s+|\\s+$', '', 'g')) >= 10 AND contains(lower(ztext), 'fehlt') THEN 'hate' ELSE 'neutral' END AS class FROM p")
def _(v):
    return classify.annotated(v.posts.select("z_pk", "ztext"), "z_pk", "ztext", "stub:fehlt").select("z_pk", "class")


@query("X6_tfidf_accuracy")
def _(v):
    rows = v.raw("documents").filter("text IS NOT NULL AND kind IS NOT NULL").select("doc_id", "text", F.when(F.col("kind") == "note", 1).otherwise(0).alias("y"))
    taught = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 0
    out = classify.tfidf_logistic(rows.filter(taught), "text", "y").transform(rows)
    right = (F.col("prediction") == F.col("y")).cast("double")
    return out.agg(F.count("*").alias("n"), F.round(F.avg(F.when(taught, right)), 3).alias("accuracy_taught"), F.round(F.avg(F.when(~taught, right)), 3).alias("accuracy_held_out"))


@query("I13_channel_steps", "SELECT username, status IN ('seed_approved', 'snowball_approved') AS may_pause FROM channels")
def _(v):
    allowed = [s for s in channels.TRANSITIONS if channels.may_become(s, "paused")]
    return v.raw("channels").select("username", F.col("status").isin(allowed).alias("may_pause"))
